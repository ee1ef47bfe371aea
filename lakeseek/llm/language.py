"""Language ID by prediction by partial matching (PPM).

Per language a context tree of bytes of variable order: its nodes are the ``nodes`` most frequent contexts of up to five bytes (each seen
``least_count`` times or more), the empty one first. A byte is coded at the longest context in the tree that the text before it ends with;
if that has not seen the byte, at an escape's cost (method C: distinct symbols over total plus distinct) it goes to the context one shorter,
whose symbols seen in the longer one are excluded, and so on; at last all of the 256 bytes still left are equally likely. The statistics are
frozen after learning, so the cost of each byte at each node is a table entry, and a text's code length in each language is exact: the
sum over all its bytes. The shortest wins; the score is its posterior under equal priors.

The tree is run as an automaton (state and byte give the next state), many pieces of texts at a time. A piece's first state follows from
the five bytes before it, as no context is longer.

Learning takes up to ``docs_per_language`` texts of each language, those of the smallest hash (a documented bound: 2,000 rows; equal rows
count once), whole. Their counts are summed in the cluster and each language's tree is built in a task; it takes 3 MB whatever the corpus.
Every language is learned; languages are scored ``block`` at a time, so that a worker holds 100 MB of tables at most.

Defined cases: a null text, one without a letter, and any text when nothing could be learned is ``und`` with score 0. Of equally
short codes the language first in order wins. Before a text's first byte stand spaces. Rows of unknown language teach nothing. Repeated
rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import P, crc_mod, drop_table, materialise, named, packed, unpacked, utf8

ORDER = 5
PIECE = 128  # bytes


def _grams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte, in the lowest place, with the ORDER before it in the text (spaces before its first) as one number."""
    at = np.arange(len(raw)) - np.repeat(off[:-1], np.diff(off))
    out = raw.astype(np.int64)
    for k in range(1, ORDER + 1):
        before = np.full(len(raw), 32, np.int64)
        before[k:] = raw[: max(0, len(raw) - k)]
        before[at < k] = 32
        out |= before << 8 * k
    return out


def sample(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str, docs_per_language: int) -> DataFrame:
    """(l, t): language and text of the learning rows."""
    lang, text = named(lang_col).cast("string"), named(text_col)
    rows = docs.filter(learnable & lang.isNotNull() & text.isNotNull()).select(named(id_col).alias("i"), lang.alias("l"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = rows.select("i", "l", "h", F.shiftrightunsigned(F.xxhash64("i", "h"), 1).alias("at"))
    # of the many rows of a language only about twice as many as wanted, by their hash, need to meet in one task
    amounts = keys.groupBy("l").agg(F.count("*").alias("n"))  # a row a language, each of which gets a model of 3 MB
    share = F.lit(2.0 * docs_per_language + 100) / F.col("n")
    few = keys.join(F.broadcast(amounts), "l").filter(F.col("at") <= F.when(share >= 1, F.lit(float(1 << 63))).otherwise(share * F.lit(float(1 << 63)))).drop("n").distinct()
    first = Window.partitionBy("l").orderBy("at", "i", "h")
    chosen = few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= docs_per_language).select(F.col("i").alias("ci"), F.col("l").alias("cl"), F.col("h").alias("ch"))
    chosen = materialise(chosen, "language-sample")
    small = F.broadcast(chosen) if chosen.count() <= 1_000_000 else chosen.hint("merge")
    taken = rows.join(small, F.col("i").eqNullSafe(F.col("ci")) & (F.col("l") == F.col("cl")) & (F.col("h") == F.col("ch")), "left_semi")
    return taken.groupBy("l", "i", "h").agg(F.first("t").alias("t")).select("l", "t")


class Tree:
    """A language's context tree as an automaton over its states, 0 being the empty context.

    steps: next state (states, 256); bits: code lengths (states, 256); usual: mean bits a byte of what it was learned from.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, nodes: int, least_count: int):
        levels = []  # of each order: contexts, and counts of (context's place * 256 + symbol)
        for order in range(ORDER + 1):
            key, at = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            context, place = np.unique(key >> 8, return_inverse=True)
            levels.append((context, place * 256 + (key & 255), np.bincount(at, n, len(key))))
        context = np.concatenate([c for c, _, _ in levels])
        order = np.repeat(np.arange(ORDER + 1), [len(c) for c, _, _ in levels])
        total = np.concatenate([np.bincount(cell // 256, count, len(c)) for c, cell, count in levels])
        # the most frequent, of equally frequent ones the shorter; the automaton needs a context's beginning and end too
        best = [i for i in np.lexsort((context, order, -total)).tolist() if total[i] >= least_count or not order[i]][:nodes]
        names: dict[tuple[int, int], int] = {}
        chosen = []
        for i in sorted(best, key=lambda i: (order[i], context[i])):
            o, c = int(order[i]), int(context[i])
            if not o or self._shorter(o, c) in names and (o - 1, c >> 8) in names:
                names[o, c] = len(chosen)
                chosen.append(i)
        counts = np.zeros((len(chosen), 256))
        first = np.concatenate([[0], np.cumsum([len(c) for c, _, _ in levels])])
        for o, (_, cell, count) in enumerate(levels):
            row = np.full(first[o + 1] - first[o], -1)
            own = [(i - first[o], k) for k, i in enumerate(chosen) if order[i] == o]
            row[[i for i, _ in own]] = [k for _, k in own]
            kept = row[cell // 256] >= 0
            counts[row[cell[kept] // 256], cell[kept] % 256] = count[kept]
        self.steps = self._automaton(names)
        self.bits = self._code_lengths(names, counts).astype(np.float32)
        state = np.zeros(len(gram), np.int64)
        for k in range(ORDER, 0, -1):
            state = self.steps[state, gram >> 8 * k & 255].astype(np.int64)
        self.usual = float((self.bits[state, gram & 255] * n).sum() / n.sum())

    @staticmethod
    def _shorter(order: int, context: int) -> tuple[int, int]:
        return order - 1, context & ((1 << 8 * (order - 1)) - 1)

    def _automaton(self, names: dict[tuple[int, int], int]) -> np.ndarray:
        """The longest context in the tree after each state's context and a byte."""
        longer: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (o, c), k in names.items():
            if o:
                longer.setdefault((o - 1, c >> 8), []).append((c & 255, k))
        steps = np.zeros((len(names), 256), np.int16)
        for (o, c), k in names.items():  # shorter ones first
            if o:
                steps[k] = steps[names[self._shorter(o, c)]]
            for byte, to in longer.get((o, c), ()):
                steps[k, byte] = to
        return steps

    def _code_lengths(self, names: dict[tuple[int, int], int], counts: np.ndarray) -> np.ndarray:
        bits = np.zeros(counts.shape)
        after = np.zeros(counts.shape)  # of a state's unseen bytes, once it has escaped
        for (o, c), k in names.items():
            own = counts[k]
            new = own > 0
            total, distinct = own.sum(), new.sum()
            if not o:
                after[k] = np.log2(max(1, 256 - distinct))
            else:
                shorter = names[self._shorter(o, c)]
                left = np.where(new, 0, counts[shorter])
                rest, some = left.sum(), (left > 0).sum()
                after[k] = after[shorter]
                if some:
                    unit = np.log2(rest + some)
                    after[k] = np.where(left > 0, unit - np.log2(np.maximum(left, 1)), after[shorter] + unit - np.log2(some))
            unit = np.log2(total + distinct)
            bits[k] = np.where(new, unit - np.log2(np.maximum(own, 1)), unit - np.log2(distinct) + after[k])
        return bits


class Model:
    """Some languages' trees side by side, the states of each behind those of the one before."""

    def __init__(self, languages: list[str], trees: list[tuple[np.ndarray, np.ndarray, float]]):
        self.languages = languages
        self.first = np.concatenate([[0], np.cumsum([len(t[0]) for t in trees])])[:-1].astype(np.int32)
        self.steps = np.concatenate([t[0].astype(np.int32) + f for t, f in zip(trees, self.first)]).ravel()
        self.bits = np.concatenate([t[1] for t in trees]).ravel()
        self.usual = np.array([t[2] for t in trees])

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of every text (rows) in every language."""
        size = np.diff(off)
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), pieces)
        start = off[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(PIECE, off[1:][text] - start)
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        state = np.repeat(self.first[:, None], len(text), axis=1)
        for k in range(ORDER, 0, -1):
            at = start - k
            byte = np.where(at >= off[:-1][text], raw[np.maximum(at, 0)], 32).astype(np.int32)
            state = self.steps[state * 256 + byte]
        out = np.zeros((len(self.languages), len(text)))
        for k in range(PIECE):
            on = int(np.searchsorted(-length, -k, side="left"))  # pieces with a byte more
            if not on:
                break
            cell = state[:, :on] * 256 + raw[start[:on] + k]
            out[:, :on] += self.bits[cell]
            state[:, :on] = self.steps[cell]
        return np.array([np.bincount(text, row, len(size)) for row in out]).T


def learn(
    docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 2000, nodes: int = 2048, least_count: int = 16, block: int = 32,
) -> list[Model]:
    """Models of all languages, ``block`` each."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            language = np.array(batch.column("l").to_pylist(), object)
            for at in range(0, batch.num_rows, 200):
                raw, off = utf8(batch.column("t").slice(at, 200))
                gram, own = _grams(raw, off), np.repeat(language[at : at + 200], np.diff(off))
                for name in set(language[at : at + 200]):
                    g, n = np.unique(gram[own == name], return_counts=True)
                    yield pa.record_batch({"l": pa.array([name] * len(g), pa.string()), "gram": g, "n": n.astype(np.int64)})

    def build(key, table):
        import pyarrow as pa

        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy().astype(float)
        tree = Tree(gram, n, nodes, least_count)
        return pa.table({"l": pa.array([key[0].as_py()], pa.string()), "steps": [tree.steps.tobytes()], "bits": [tree.bits.tobytes()], "usual": [tree.usual]})

    counted = sample(docs, learnable, id_col, text_col, lang_col, docs_per_language).mapInArrow(count, "l string, gram bigint, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    built = materialise(counted.groupBy("l").applyInArrow(build, "l string, steps binary, bits binary, usual double"), "language-trees")
    names = sorted(r[0] for r in built.select("l").collect())
    models = []
    for at in range(0, len(names), block):
        own = names[at : at + block]
        rows = {r.l: r for r in built.filter(F.col("l").isin(own)).collect()}
        tables = [(np.frombuffer(rows[x].steps, np.int16).reshape(-1, 256), np.frombuffer(rows[x].bits, np.float32).reshape(-1, 256), rows[x].usual) for x in own]
        models.append(Model(own, tables))
    drop_table(built)
    return models


def _lettered(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    low = raw | 32
    ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = np.diff(ascii_[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def languages_of(texts, models: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language (``und`` if none), score and excess (bits a byte over the language's usual; NaN for ``und``) of an Arrow column; ``models`` gives each when asked."""
    raw, off = utf8(texts)
    n = len(off) - 1
    names, score, excess = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
    ok = np.flatnonzero(_lettered(raw, off))
    if len(ok) and models:
        least, total = np.full(len(ok), np.inf), np.zeros(len(ok))  # the shortest code, and all languages' odds against it
        for get in models:
            model = get()
            bits = model.lengths(raw, off)[ok]
            best = bits.argmin(1)
            own = bits[np.arange(len(ok)), best]
            better = own < least
            now = np.where(better, own, least)
            with np.errstate(invalid="ignore"):
                total = np.where(np.isinf(least), 0, total * np.exp2(np.maximum(now - least, -1000))) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(1)
            names[ok[better]] = np.array(model.languages, object)[best[better]]
            excess[ok[better]] = own[better] / np.diff(off)[ok[better]] / model.usual[best[better]]
            least = now
        score[ok] = 1 / total
    return names.tolist(), score, excess


def language_columns(rows: DataFrame, models: list[Model], text_at: int | None = None) -> DataFrame:
    """Packed rows with P + lang_pred, P + score and P + excess; the text is the row's field of this place, or P + t."""
    sc = rows.sparkSession.sparkContext
    shared = [sc.broadcast(m) for m in models]  # 3 MB a language

    def predict(batches):
        import pyarrow as pa

        def getter(one):
            def get():
                value = one.value
                if len(shared) > 1:  # held only while it is used
                    one.__dict__.pop("_value", None)
                return value

            return get

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, score, excess = languages_of(part.column(1) if text_at is None else part.column(0).field(text_at), [getter(b) for b in shared])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(excess, from_pandas=True)], [P + "row", P + "lang_pred", P + "score", P + "excess"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kinds = [StructField(P + "lang_pred", StringType()), StructField(P + "score", DoubleType()), StructField(P + "excess", DoubleType())]
    return rows.mapInArrow(predict, StructType([rows.schema[P + "row"], *kinds]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, **options) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows of the other folds."""
    held_out = crc_mod(id_col, fold) == 0
    models = learn(docs, ~F.coalesce(held_out, F.lit(True)), id_col, text_col, lang_col, **options)
    row = F.struct(named(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    seen = language_columns(docs.select(row.alias(P + "row"), named(text_col).alias(P + "t")), models)
    return seen.select(F.col(P + "row").getField("id").alias(id_col), F.col(P + "row").getField("held_out").alias("held_out"), F.col(P + "lang_pred").alias("lang_pred"), F.col(P + "score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5, most_excess: float = 5.0, least_bytes: int = 50, fold: int = 5) -> DataFrame:
    """``docs`` without rows of no language: ``und``, and of texts of ``least_bytes`` or more those of an even score or a code much longer than the language's own texts have.

    Shorter texts say too little for either test and stay.
    """
    models = learn(docs, F.coalesce(crc_mod(id_col, fold) != 0, F.lit(False)), id_col, text_col, lang_col)
    seen = language_columns(packed(docs), models, docs.columns.index(text_col))
    sure = (F.col(P + "score") >= least_score) & (F.col(P + "excess") <= most_excess)
    ok = (F.col(P + "lang_pred") != "und") & (sure | (F.octet_length(F.col(P + "row").getField(text_col)) < least_bytes))
    return seen.filter(ok).select(*unpacked(seen, docs.columns))
