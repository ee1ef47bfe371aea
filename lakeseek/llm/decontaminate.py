"""Benchmark decontamination in DataFrame functions only.

A text is contaminated by an item if one of its windows of the item's number of words has a weighted Jaccard similarity of at least
``threshold`` with the item, over word shingles weighted by how often they occur. The steps:

1. Windows that can't be similar to any item of their size go: of every text, shingles (A-Z lower-cased words, five each) that no item has
   are left out, and for each size of item the windows that hold fewer than the 2s/(1+s) m shingles of such items that two windows of m
   shingles and similarity s share. Which item it is plays no part yet. Of the rest only such windows as none beside them is sure to equal
   or beat for every item are laid: a window that starts on no matched shingle yields to the next one, and one whose last shingle is not
   matched, to the one before, if that starts on a matched one.
2. Each window laid, and each item, gets a 64-bit SimHash over its shingles.
3. Multi-index Hamming blocks find the candidates: four blocks of 16 bits; of two fingerprints within ``radius`` one block differs in at most
   a quarter of it, so the items are dealt out under all block values that near, the windows under their own. Every item of the window's
   size within the radius is met; the Hamming distance is verified. At a similarity of 0.8 about 10 of 64 bits differ, with a deviation
   of 3: the radius of 19 leaves out about one in 3,000 such windows, fewer of more similar ones.
4. The exact weighted similarity decides. The best window of each text and item is told, of equal ones the first laid.

What is broadcast is counted first: items' shingles, items' block values and the ids of texts that passed step 1, up to ``broadcast_rows``
values (rows by columns; a value takes some 20 to 60 bytes of a hash table); beyond that the same joins are merged, and so are all joins of places, windows
and shingles of the texts. None is left to the planner: it sees the size of a compressed file, and copies of one text make a small file of any
number of rows. A common shingle meets the sizes of the items that have it, not the items.

Defined cases: null and wordless texts and items match nothing. An item of fewer words than a shingle has one shingle, its whole
sequence, and a text shorter than the item is one window, whole. Equal rows count as one text. Several texts under one item_id are
items of their own; the best of them is told. Null ids are ids. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import SPACES, P, drop_table, materialise, named, packed, unpacked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _word_hashes(text: Column) -> Column:
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES, UPPER.lower() + " " * len(SPACES))
    return F.transform(F.filter(F.split(flat, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(text: Column, size: int) -> Column:
    """struct(n: number of words, h: hashes of the shingles of ``size`` words, in order)."""

    def of(words: Column) -> Column:
        last = F.size(words) - F.lit(size)
        at = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(words).alias("n"), F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, (i + F.lit(k)).cast("int")) for k in range(size)])).alias("h"))

    return F.element_at(F.transform(F.array(_word_hashes(text)), of), 1)


LANES = 1 + (1 << 21) + (1 << 42)  # three counters in one number, each of 20 bits and one for the comparison: windows of up to a million words


def _simhash_sums() -> list[Column]:
    """Sums of the bits of the hashes h of a group, three counters in each of 22 numbers. As SQL text, which is planned far faster than as many calls."""
    lanes = "(shiftrightunsigned(h, {0}) & 1) + shiftleft(shiftrightunsigned(h, {0}) & 2, 20) + shiftleft(shiftrightunsigned(h, {0}) & 4, 40)"
    return [F.expr(f"sum({lanes.format(3 * g)}) AS s{g}") for g in range(22)]


def _simhash(count: str) -> Column:
    """Adding to a counter what carries it over 2**20 if it is more than half of ``count`` compares all three at once; 64 of the 66 flags are the fingerprint."""
    over = [f"((s{g} + (1048575 - {count} div 2) * {LANES}) & {LANES << 20})" for g in range(22)]
    bits = [f"shiftrightunsigned({x}, {20 - g})" for g, x in enumerate(over[:21])] + [f"shiftleft({over[21]} & 1048576, 43)"]
    return F.expr(" | ".join(bits))


def _blocks(fp: Column, n: int) -> list[Column]:
    width = 64 // n
    return [F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(n)]


def _near_values(n: int, radius: int) -> Column:
    """Masks of the block values that differ in at most radius // n bits: one literal, as thousands would burden the planner."""
    width = 64 // n
    masks = [sum(1 << b for b in bits) for r in range(radius // n + 1) for bits in combinations(range(width), r)]
    return F.transform(F.split(F.lit(" ".join(map(str, masks))), " "), lambda x: x.cast("long"))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = 5, threshold: float = 0.8, radius: int = 19, blocks: int = 4, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(P + id, P + t: xxhash64 of the text, item_id, start_word, n_item_words, similarity): the best window of each contaminated (text, item)."""

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows * len(df.columns) <= broadcast_rows else df.hint("merge")

    item_text = named(item_text_col)
    base = items.select(named(item_col).alias("item"), F.xxhash64(item_text).alias("it"), item_text.alias("text"), F.least(F.size(_word_hashes(item_text)), F.lit(shingle)).alias("k")).filter("k > 0")
    of_size = [base.filter(F.col("k") == k).select("item", "it", "k", _shingles(F.col("text"), k).alias("s")) for k in range(1, shingle + 1)]
    rows = of_size[0]
    for more in of_size[1:]:
        rows = rows.unionByName(more)
    # one row a shingle; equal items under one id are one
    parts = materialise(
        rows.distinct().select("item", "it", "k", F.col("s.n").alias("n"), F.size("s.h").alias("m"), F.posexplode("s.h").alias("j", "h")).withColumn("h", F.xxhash64("h", "k")), "item-shingles"
    )
    n_parts = parts.count()
    sizes = [r[0] for r in parts.select("k").distinct().collect()]  # at most ``shingle`` values

    own = docs.select(named(id_col).alias(P + "id"), F.xxhash64(named(text_col)).alias(P + "t"), named(text_col).alias("text"))
    key = [P + "id", P + "t"]

    def exploded(of: DataFrame) -> DataFrame:
        out = None
        for k in sorted(sizes) or [shingle]:
            one = of.select(*key, F.lit(k).alias("k"), _shingles(F.col("text"), k).alias("s")).select(*key, "k", F.col("s.n").alias("n_doc"), F.posexplode("s.h").alias("p", "h"))
            one = one.withColumn("h", F.xxhash64("h", "k"))
            out = one if out is None else out.unionByName(one)
        return out

    def matched(left: DataFrame, right: DataFrame, columns: dict[str, str], how: str = "inner") -> DataFrame:
        """Join on columns that may be null; the right ones are renamed and dropped. ``right`` brings its hint."""
        renamed = {r: f"r_{i}" for i, r in enumerate(columns.values())}
        right = right.withColumnsRenamed(renamed)
        out = left.join(right, [left[c].eqNullSafe(right[renamed[r]]) for c, r in columns.items()], how)
        return out if how == "left_semi" else out.drop(*renamed.values())

    # step 1: positions whose shingle an item of the size has
    of_h = parts.select("h", "n", "m", "k").distinct()
    hits = materialise(exploded(own).drop("k").join(small(parts.select("h").distinct(), n_parts), "h", "left_semi").distinct(), "item-hits")
    size = [*key, "n", "m", "k"]
    share = 2 * threshold / (1 + threshold)
    # a text shorter than the item may have fewer shingles than it: then Jaccard asks for threshold times the item's
    short = F.col("n_doc") < F.col("n")
    need = F.ceil(F.when(short, F.lit(threshold) * F.col("m")).otherwise(F.lit(share) * F.col("m")) - F.lit(1e-9)).cast("int")
    placed = hits.join(small(of_h, n_parts), "h").groupBy(*size, "n_doc").agg(F.sort_array(F.collect_set("p")).alias("at"))  # of one text
    placed = materialise(placed.withColumn("need", need).withColumn("last", (F.col("n_doc") - F.col("n")).cast("int")).filter(F.size("at") >= F.col("need")), "item-places")

    def start_at(p: Column, i: Column) -> Column:
        reaches = F.coalesce(F.get("at", i + F.col("need") - F.lit(1)) <= p + F.col("m") - F.lit(1), F.lit(False))
        return F.struct(p.alias("start"), (reaches & (p < F.col("last"))).alias("ok"), F.coalesce(F.get("at", i - F.lit(1)) == p - F.lit(1), F.lit(False)).alias("follows"))

    starts = placed.filter(~short).select(*size, F.explode(F.filter(F.transform("at", start_at), lambda x: x["ok"])).alias("x")).select(*size, "x.start", "x.follows", (F.col("x.start") + F.col("m") - F.lit(1)).alias("end"))
    ends = placed.select(*key, "n", "k", F.explode("at").alias("p"))
    going_on = matched(starts.filter("follows"), ends.hint("merge"), {**{c: c for c in (*key, "n", "k")}, "end": "p"}, "left_semi")
    at_end = placed.filter(~short & (F.get("at", F.size("at") - F.col("need")) >= F.col("last"))).select(*size, F.col("last").alias("start"))
    whole = placed.filter(short).select(*size, F.lit(0).alias("start"))
    laid = [starts.filter("NOT follows").select(*size, "start"), going_on.select(*size, "start"), at_end, whole]
    windows = laid[0]
    for more in laid[1:]:
        windows = windows.unionByName(more)
    windows = materialise(windows, "item-windows")

    # step 2: texts that have a window, shingle by shingle; then the windows that hold each
    chosen = materialise(windows.select(*key).distinct(), "hit-texts")
    again = matched(own, small(chosen, chosen.count()), {c: c for c in key}, "left_semi").distinct()
    pieces = exploded(again).drop("n_doc")
    wins = windows.withColumnsRenamed({P + "id": "cid", P + "t": "ct", "k": "wk"}).hint("merge")
    inside = (F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + F.col("m"))
    held = pieces.join(wins, pieces[P + "id"].eqNullSafe(wins.cid) & (pieces[P + "t"] == wins.ct) & (wins.wk == pieces.k) & inside)
    win = [*size, "start"]
    held = materialise(held.select(*win, "h"), "window-shingles")
    prints = held.groupBy(*win).agg(F.count("*").alias("mw"), *_simhash_sums()).select(*win, "mw", _simhash("mw").alias("fp"))
    one = ["item", "it", "n", "k"]
    item_prints = parts.groupBy(*one).agg(F.count("*").alias("mi"), *_simhash_sums()).select(*one, _simhash("mi").alias("item_fp"))

    # step 3: the items that share a near block with a window of their size
    def dealt(df: DataFrame, fp: str, value) -> DataFrame:
        return df.withColumn("b", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(_blocks(F.col(fp), blocks))]))).withColumns({"block": F.col("b.i"), "v": value(F.col("b.v"))}).drop("b")

    near_values = _near_values(blocks, radius)
    right = dealt(item_prints, "item_fp", lambda v: F.explode(F.transform(near_values, lambda mask: v.bitwiseXOR(mask))))
    n_items = item_prints.count()
    masks = sum(1 for r in range(radius // blocks + 1) for _ in combinations(range(64 // blocks), r))
    near_rows = n_items * blocks * masks
    met = dealt(prints, "fp", lambda v: v).join(small(right, near_rows), ["n", "k", "block", "v"])
    near = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*win, "mw", "item", "it").distinct()
    near = materialise(near, "near-windows")

    # step 4
    counts = matched(held, near.select(*win).hint("merge"), {c: c for c in win}, "left_semi").groupBy(*win, "h").agg(F.count("*").alias("a"))
    item_counts = parts.groupBy("item", "it", "h").agg(F.count("*").alias("b"))
    pairs = matched(near.select(*win, "item", "it"), small(item_counts, n_parts), {"item": "item", "it": "it"})
    common = matched(pairs, counts.hint("merge"), {**{c: c for c in win}, "h": "h"}).groupBy(*win, "item", "it").agg(F.sum(F.least("a", "b")).alias("common"))
    judged = matched(near, common.hint("merge"), {c: c for c in (*win, "item", "it")}).withColumn("similarity", F.col("common") / (F.col("mw") + F.col("m") - F.col("common")))
    judged = judged.filter(F.col("similarity") >= threshold - 1e-9)
    best = judged.groupBy(*key, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    best = materialise(best, "contaminations")
    drop_table(parts, hits, placed, windows, chosen, held, near)
    return best.select(*key, F.col("item").alias(item_col), (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_item_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without the contaminated rows, columns as they are whatever their names."""
    found = contaminated(docs, items, id_col, text_col, broadcast_rows=broadcast_rows, **options)
    bad = found.select(F.col(P + "id").alias("bad_id"), F.col(P + "t").alias("bad_text")).distinct()
    bad = F.broadcast(bad) if found.count() * len(bad.columns) <= broadcast_rows else bad.hint("merge")
    keyed = packed(docs, id=named(id_col), t=F.xxhash64(named(text_col)))
    clean = keyed.join(bad, F.col(P + "id").eqNullSafe(F.col("bad_id")) & (F.col(P + "t") == F.col("bad_text")), "left_anti")
    return clean.select(*unpacked(clean, docs.columns))
