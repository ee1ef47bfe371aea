"""LM scoring with Brown classes.

Words are grouped in classes by exchange clustering; a text's probability is the product over its tokens of the class-transition
probability and the word's emission probability in its class, both smoothed. The text's end is a token of its own class, and every
text starts after an end.

Every word of the training texts is assigned by exchange. The ``core``, the most frequent words, is clustered first, on its own bigram
counts: exchange moves a word to the class that raises the likelihood of the class bigrams most, in rounds over all words until none moves
or ``rounds`` are done. Then every other word is given, in the cluster, the class of the greatest exchange gain against those class
bigrams: from how often it stands after and before each class (of core words and ends), summed per word. A word that never stands
beside one takes the class that most words seen once took, and so does a word not seen in training.

transition(d | c) = (n(c, d) + m * n(d) / N) / (n(c) + m); emission(w | c) = (n(w) + k) / (n(c) + k (v(c) + 1)), v(c) the class's distinct
words, with one unknown word in every class. Counts are of all training texts and all words.

Passes over the texts: count words; count core bigrams; collect the other words' neighbours; count class bigrams; score. The driver holds
the core's bigrams (``core`` squared, 8 MB), the class bigrams and the ``head`` most frequent words with their counts and classes (24 bytes
each, broadcast for the last two passes), however large the corpus. The other words of a text travel to the table of all words and their counts and
classes come back by row. Common words never do. Words are 64-bit hashes (exact ones of short words are mixed, see ``common.word_hashes``).

A task works on about a megabyte of text at a time and adds up what it holds an eighth of the hashes after another, so a worker's memory follows neither
the texts' lengths, beyond its longest one, nor Arrow's batches. While its passes run, the session hands out Arrow batches of BATCH rows at most: of 10,000 texts they take
tens of MB several times over, in the JVM and in each worker.

Of equally frequent words at the end of core or head those of the smallest hashes are in, about as many as there is room for.

Defined cases: a null text counts as empty: one token, the end. Equal rows are scored alike, each a row of its own. A null id is never
held out. With nothing to learn from, all counts are 0. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import P, crc_mod, drop_table, lower_ascii, materialise, named, utf8, word_bounds, word_hashes

END = 0  # the class and core number of a text's end
BATCH = 1000  # texts
BYTES = 1 << 20  # of text
EIGHTHS = 8  # what tasks hold is added up by the first bits of the hash


@contextmanager
def _small_batches(spark: SparkSession):
    """The session's Arrow batches have at most BATCH rows meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(BATCH, int(before)) if int(before) > 0 else BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _cuts(column) -> list[tuple[int, int]]:
    """(first, number) of the slices of an Arrow string column: at most BATCH texts, and about BYTES or one text."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    at = np.arange(len(size))
    new = np.diff((np.cumsum(size) - size) // BYTES, prepend=-1) > 0
    first = np.flatnonzero(new | (at % BATCH == 0))
    return list(zip(first.tolist(), np.diff(np.append(first, len(size))).tolist()))


def _eighths(h: np.ndarray):
    """Masks of the hashes of each eighth, of those that have some."""
    part = (h >> np.uint64(61)).astype(np.int8)
    return (part == p for p in np.flatnonzero(np.bincount(part, minlength=EIGHTHS)))


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the texts' offsets."""
    raw, off = utf8(column)
    raw = lower_ascii(raw)
    starts, ends, offs = word_bounds(raw, off)
    return word_hashes(raw, starts, ends), offs


class Words:
    """Sorted hashes and a value of each; others have ``absent``."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], [v[order] for v in values]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places in the sorted hashes, -1 for words that aren't there."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, at, -1)

    def value(self, words: np.ndarray, which: int = 0, absent: int = -1) -> np.ndarray:
        at = self.find(words)
        return np.where(at >= 0, self.values[which][at], absent) if len(self.hashes) else np.full(len(words), absent)


def count_words(train: DataFrame, flush: int = 1_500_000) -> DataFrame:
    """(h, n) of every word: hash and count. Each task adds up its own words, about ``flush`` entries at a time."""

    def run(batches):
        import pyarrow as pa

        held: list = []
        size = 0

        def emit():
            h, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            held.clear()
            for own in _eighths(h):
                u, at = np.unique(h[own], return_inverse=True)
                yield pa.record_batch({"h": u.view(np.int64), "n": np.bincount(at, n[own], len(u)).astype(np.int64)})

        for batch in batches:
            for at, some in _cuts(batch.column(P + "t")):
                held.append(np.unique(_tokens(batch.column(P + "t").slice(at, some))[0], return_counts=True))
                size += len(held[-1][0])
                if size > flush:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    return train.select(P + "t").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, room: int, *more: str) -> dict[str, np.ndarray]:
    """Columns h, n and ``more`` of the most frequent words, the most frequent first, about ``room`` of them.

    The least count comes from histograms, over steps of a sixteenth of a doubling and then over the counts of one step, so only the
    words themselves are brought together. Of the words with the last count a share is taken by their hash.
    """
    step = F.floor(F.log2("n") * 16).cast("int")

    def crossing(rows, left: int):
        for value, count in sorted(((r[0], r[1]) for r in rows), reverse=True):
            if count > left:
                return value, left, count
            left -= count
        return None

    chosen = words
    by_step = crossing(words.groupBy(step.alias("step")).count().collect(), room)  # some hundred rows
    if by_step:
        inside = words.filter(step == by_step[0]).groupBy("n").count().collect()  # the counts within a sixteenth of a doubling
        least, left, tied = crossing(inside, by_step[1])
        share = int(left / tied * (1 << 32))
        chosen = words.filter((F.col("n") > least) | ((F.col("n") == least) & (F.shiftrightunsigned(F.xxhash64("h"), 32) < share)))
    rows = chosen.select("h", "n", *more).toArrow()
    out = {c: np.asarray(rows[c]) for c in ("h", "n", *more)}
    order = np.lexsort((out["h"], -out["n"]))
    return {c: v[order] for c, v in out.items()}


def exchange(counts: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """The class of each type, by exchange on the bigram counts of types. Class 0 is the end's alone; ties go to the lower class."""
    k = len(counts)
    counts = counts.astype(float)
    total = counts.sum(0) + counts.sum(1)
    rank = np.argsort(-total[1:], kind="stable") + 1
    of = np.zeros(k, int)
    of[rank] = 1 + np.arange(k - 1) % max(1, classes - 1)
    if classes < 3 or k < 3:
        return of
    f = lambda x: x * np.log(np.maximum(x, 1e-300)) * (x > 0)
    onehot = np.zeros((k, classes))
    onehot[np.arange(k), of] = 1
    right, left = counts @ onehot, counts.T @ onehot  # of each type with each class after and before it
    table = onehot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in rank:
            c = of[w]
            out, into, own = right[w].copy(), left[w].copy(), counts[w, w]
            if not total[w]:
                continue
            # take w out of its class
            out[c] -= own
            into[c] -= own
            table[c] -= out
            table[:, c] -= into
            table[c, c] -= own
            rows, cols = table.sum(1), table.sum(0)
            so, si = out.sum() + own, into.sum() + own
            # what each class would gain from w
            gain = (f(table + out[None, :]) - f(table)).sum(1) + (f(table + into[:, None]) - f(table)).sum(0)
            d = np.diag(table)
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(rows + so) - f(rows) + f(cols + si) - f(cols)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            if best != c:
                moved += 1
                of[w] = best
                right[:, c] -= counts[:, w]
                right[:, best] += counts[:, w]
                left[:, c] -= counts[w]
                left[:, best] += counts[w]
        if not moved:
            break
    return of


def _with_ends(line: np.ndarray, offs: np.ndarray, end: int = END) -> np.ndarray:
    """The texts' tokens with an end after each text."""
    return np.insert(line, offs[1:], end)


def core_bigrams(train: DataFrame, core: Words, size: int) -> np.ndarray:
    """Counts of core numbers (size, size) that follow one another, others left out."""

    def run(batches):
        import pyarrow as pa

        own = np.zeros(size * size, np.int64)
        for batch in batches:
            for at, some in _cuts(batch.column(P + "t")):
                words, offs = _tokens(batch.column(P + "t").slice(at, some))
                line = _with_ends(core.value(words), offs)
                before = np.concatenate([[END], line[:-1]])
                both = (line >= 0) & (before >= 0)
                own += np.bincount(before[both] * size + line[both], minlength=size * size)
        some = np.flatnonzero(own)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.record_batch({"cell": part.astype(np.int32), "n": own[part]})

    cells = train.select(P + "t").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").cast("long").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[np.asarray(cells["cell"])] = np.asarray(cells["n"])
    return out.reshape(size, size)


def neighbours(train: DataFrame, classes_of: Words, classes: int, flush: int = 3_000_000) -> DataFrame:
    """(h, cell, n) of the words without a class in ``classes_of``: how often after a class c (cell c) and before one (classes + c)."""
    width = 2 * classes

    def run(batches):
        import pyarrow as pa

        cells: list = []
        size = 0

        def emit():
            h, cell = (np.concatenate([x[i] for x in cells]) for i in range(2))
            cells.clear()
            for own in _eighths(h):
                u, at = np.unique(h[own], return_inverse=True)
                key, n = np.unique(at * width + cell[own], return_counts=True)
                yield pa.record_batch({"h": u[key // width].view(np.int64), "cell": (key % width).astype(np.int16), "n": n})

        for batch in batches:
            for at, some in _cuts(batch.column(P + "t")):
                words, offs = _tokens(batch.column(P + "t").slice(at, some))
                line = _with_ends(classes_of.value(words), offs)
                hashes = np.insert(words, offs[1:], 0)
                own = np.flatnonzero(line < 0)  # never the last token, which is an end
                before, after = np.concatenate([[END], line[:-1]])[own], line[own + 1]
                cells.append((hashes[own[before >= 0]], before[before >= 0].astype(np.int16)))
                cells.append((hashes[own[after >= 0]], (classes + after[after >= 0]).astype(np.int16)))
                size += 2 * len(own)
                if size > flush:
                    yield from emit()
                    size = 0
        if size:
            yield from emit()

    return train.select(P + "t").mapInArrow(run, "h bigint, cell smallint, n bigint")


def gains(table: np.ndarray) -> np.ndarray:
    """Of each cell (rows) the gain in likelihood that one count of it gives each class, from the class bigrams."""
    smooth = table + 0.1
    ratio = np.log(smooth) - np.log(smooth.sum(1))[:, None] - np.log(smooth.sum(0))[None, :]
    out = np.concatenate([ratio, ratio.T])
    out[:, END] = 0  # no word's class
    return out


def assign(cells: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, class) of the words of ``cells`` (h, cell, n): class of the greatest gain, of equal ones the lowest."""
    gain = gains(table)
    size = len(gain)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen = batch.column("v")
            flat = seen.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(seen.offsets)))
            cell, n = np.asarray(flat.field("cell")).astype(np.int64), np.asarray(flat.field("n")).astype(float)
            counts = np.bincount(row * size + cell, n, batch.num_rows * size).reshape(-1, size)
            yield pa.record_batch({"h": batch.column("h"), "class": (1 + (counts @ gain)[:, 1:].argmax(1)).astype(np.int16)})

    vectors = cells.groupBy("h", "cell").agg(F.sum("n").alias("n")).groupBy("h").agg(F.collect_list(F.struct("cell", "n")).alias("v"))  # as many as cells at most
    return vectors.mapInArrow(run, "h bigint, class smallint")


def class_bigrams(train: DataFrame, frequent: Words, lexicon: DataFrame, classes: int, unknown: int) -> np.ndarray:
    """Counts of classes (classes, classes) that follow one another, of all tokens: the frequent words' added up in the tasks, the others joined."""

    def run(batches):
        import pyarrow as pa

        own = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for at, some in _cuts(batch.column(P + "t")):
                words, offs = _tokens(batch.column(P + "t").slice(at, some))
                line = _with_ends(frequent.value(words), offs)
                hashes = np.insert(words, offs[1:], 0)
                before = np.concatenate([[END], line[:-1]])
                both = (line >= 0) & (before >= 0)
                own += np.bincount(before[both] * classes + line[both], minlength=classes * classes)
                rare = np.flatnonzero(line < 0)
                after = line[rare + 1]
                yield pa.record_batch({
                    "cell": np.full(len(rare), -1, np.int32), "n": np.ones(len(rare), np.int64), "h": hashes[rare].view(np.int64), "before": before[rare].astype(np.int16),
                    "after": after.astype(np.int16), "g": np.where(after < 0, hashes[rare + 1], 0).view(np.int64),
                })
        some = np.flatnonzero(own)
        none = np.zeros(len(some), np.int64)
        yield pa.record_batch({"cell": some.astype(np.int32), "n": own[some], "h": none, "before": none.astype(np.int16), "after": none.astype(np.int16), "g": none})

    rows = materialise(train.select(P + "t").mapInArrow(run, "cell int, n bigint, h bigint, before smallint, after smallint, g bigint"), "class-bigrams")
    out = np.zeros((classes, classes))
    flat = out.reshape(-1)
    for cell, n in rows.filter("cell >= 0").groupBy("cell").agg(F.sum("n")).collect():
        flat[cell] += n
    known = lexicon.select("h", "class")
    rare = rows.filter("cell < 0").join(known, "h", "left").select("before", "after", "g", F.coalesce("class", F.lit(unknown)).alias("own"))
    rare = materialise(rare.groupBy("before", "after", "g", "own").agg(F.count("*").alias("n")), "rare-bigrams")
    for before, after, c, n in rare.groupBy("before", "after", "own").agg(F.sum("n")).collect():  # as many as classes to the third at most
        if before >= 0:
            out[before, c] += n
        if after >= 0:
            out[c, after] += n
    pairs = rare.filter("after < 0").select("own", "n", F.col("g").alias("h")).join(known, "h", "left").groupBy("own", F.coalesce("class", F.lit(unknown)).alias("next")).agg(F.sum("n"))
    for first, second, n in pairs.collect():
        out[first, second] += n
    drop_table(rows, rare)
    return out


def class_lm(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, core: int = 1000, classes: int = 64, head: int = 200_000, k: float = 0.1, m: float = 5.0,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    with _small_batches(docs.sparkSession):
        return _class_lm(docs, id_col, text_col, fold, core, classes, head, k, m)


def _class_lm(docs: DataFrame, id_col: str, text_col: str, fold: int, core: int, classes: int, head: int, k: float, m: float) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    held_out = F.coalesce(crc_mod(id_col, fold) == 0, F.lit(False))
    rows = docs.select(named(id_col).alias(P + "id"), held_out.alias("held_out"), named(text_col).alias(P + "t"))
    train = rows.filter("NOT held_out")
    counted = materialise(count_words(train), "word-counts")
    n_texts = train.count()
    sums = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the end is one more known token, once a text
    distinct, total = sums[0] + (n_texts > 0), sums[1] + n_texts
    common = most_frequent(counted, core)
    core_hashes = common["h"].view(np.uint64)
    size = len(core_hashes) + 1
    between = core_bigrams(train, Words(core_hashes, np.arange(1, size)), size)
    of = exchange(between, classes)
    onehot = np.zeros((size, classes))
    onehot[np.arange(size), of] = 1

    # all other words
    around = neighbours(train, Words(core_hashes, of[1:]), classes)
    assigned = assign(around, onehot.T @ between @ onehot)
    known = F.broadcast(docs.sparkSession.createDataFrame([(int(h), int(c)) for h, c in zip(common["h"], of[1:])], "ch bigint, cc smallint"))  # the core
    told = counted.join(assigned, "h", "left").join(known, F.col("h") == F.col("ch"), "left").select("h", "n", F.coalesce("cc", "class").alias("class"))
    told = materialise(told, "word-classes")
    once = told.join(known, F.col("h") == F.col("ch"), "left_anti").filter("n = 1 AND class IS NOT NULL").groupBy("class").count().collect()
    unknown = min(once, key=lambda r: (-r[1], r[0]))[0] if once else int(of[1:].min()) if size > 1 else min(1, classes - 1)
    lexicon = told.select("h", "n", F.coalesce("class", F.lit(unknown)).cast("smallint").alias("class"))
    best = most_frequent(lexicon, head, "class")
    frequent = Words(best["h"].view(np.uint64), best["class"].astype(np.int64), best["n"].astype(float))
    bigram = class_bigrams(train, Words(frequent.hashes, frequent.values[0]), lexicon, classes, unknown)
    distinct_words = np.zeros(classes)
    for c, n in lexicon.groupBy("class").count().collect():
        distinct_words[c] = n
    distinct_words[END] = n_texts > 0
    after, before = bigram.sum(0), bigram.sum(1)
    step = np.log10((bigram + m * (after / max(1.0, after.sum()))[None, :] + 1e-12) / (before[:, None] + m))
    unit = np.log10(np.maximum(after + k * (distinct_words + 1), 1e-12))
    log_base = float(np.log10(max(total + k * (distinct + 1), 1e-12)))
    shared = sc.broadcast((frequent, step, unit))  # bounded by head and classes
    end = float(n_texts)
    id_type = docs.schema[id_col].dataType.simpleString()
    drop_table(counted)

    def score(batches):
        import pyarrow as pa

        frequent, step_, unit_ = shared.value
        for batch in batches:
            for at, some in _cuts(batch.column(P + "t")):
                part = batch.slice(at, some)
                words, offs = _tokens(part.column(P + "t"))
                n = len(offs) - 1
                place = frequent.find(words)
                hit = place >= 0
                inner = np.where(hit, frequent.values[0][place], -1) if len(frequent.hashes) else place
                line = _with_ends(inner, offs)
                before = np.concatenate([[END], line[:-1]])
                owner = np.repeat(np.arange(n), np.diff(offs) + 1)
                own = line >= 0
                known_move = own & (before >= 0)
                move = np.where(known_move, step_[before, line], 0.0) - np.where(own, unit_[line], 0.0)
                value = np.zeros(len(words))
                if hit.any():
                    value[hit] = np.log10(frequent.values[1][place[hit]] + k)
                value = _with_ends(value, offs, np.log10(end + k))
                doc = np.repeat(np.arange(n), np.diff(offs))
                tail = np.flatnonzero(~own)
                edges = np.searchsorted(owner[tail], np.arange(n + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays(
                    [pa.array(np.insert(words, offs[1:], 0)[tail].view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(before[tail].astype(np.int16)), pa.array(line[tail + 1].astype(np.int16))],
                    ["h", "at", "before", "after"],
                )
                yield pa.record_batch({
                    P + "id": part.column(P + "id"), "held_out": part.column("held_out"), "n_tokens": (np.diff(offs) + 1).astype(np.int64),
                    "seen": (np.bincount(doc[hit], minlength=n) + (end > 0)).astype(np.int64), "common": np.bincount(owner, value, n), "moves": np.bincount(owner, move, n),
                    "rest": pa.ListArray.from_arrays(pa.array(edges), rest),
                })

    kinds = f"`{P}id` {id_type}, held_out boolean, n_tokens bigint, seen bigint, common double, moves double, rest array<struct<h:bigint,at:int,before:smallint,after:smallint>>"
    scored = materialise(rows.mapInArrow(score, kinds).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    tail = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.at", "x.before", "x.after")
    found = tail.join(lexicon, "h", "left").select("row", "at", "before", "after", F.coalesce("n", F.lit(0)).alias("c"), F.coalesce("class", F.lit(unknown)).cast("smallint").alias("d"))
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("at", "before", "after", "c", "d")).alias("x"))  # the rare words of one text

    def finish(batches):
        import pyarrow as pa

        _, step_, unit_ = shared.value
        for batch in batches:
            seen = batch.column("x")
            flat = seen.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(seen.offsets)))
            at, before, after, c, d = (np.asarray(flat.field(f)).astype(np.int64) for f in ("at", "before", "after", "c", "d"))
            order = np.lexsort((at, row))
            row, at, before, after, c, d = (x[order] for x in (row, at, before, after, c, d))
            # a rare word after a rare word: the row before is that one
            before[1:] = np.where(before[1:] < 0, d[:-1], before[1:])
            move = step_[before, d] - unit_[d] + np.where(after >= 0, step_[d, after], 0.0)
            value = np.log10(c + k)
            n = batch.num_rows
            yield pa.record_batch({"row": batch.column("row"), "more": np.bincount(row, value, n), "more_moves": np.bincount(row, move, n), "more_seen": np.bincount(row[c > 0], minlength=n).astype(np.int64)})

    sums = by_row.mapInArrow(finish, "row bigint, more double, more_moves double, more_seen bigint")
    out = scored.drop("rest").join(sums, "row", "left")
    emitted = F.col("common") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col(P + "id").alias(id_col), "held_out", "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (emitted - F.col("n_tokens") * F.lit(log_base)).alias("base_score"), (emitted + F.col("moves") + F.coalesce("more_moves", F.lit(0.0))).alias("score"),
    )
