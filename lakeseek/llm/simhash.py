"""SimHash near-dedup: fingerprints over word shingles, pigeonhole blocks, Hamming verification, components.

A 64-bit fingerprint is split into ``blocks`` blocks. Two fingerprints that differ in at most ``radius`` bits share at least blocks - radius
whole blocks, so they meet under one of the keys of so many blocks: 6 keys of 32 bits for radius 2 in 4 blocks, 35 of 27 bits for
radius 4 in 7. Equal fingerprints are one node, whatever the number of copies. Within a key of up to ``hot`` fingerprints the pairs are
verified by their Hamming distance. A key of more is not paired: each of its fingerprints goes to all values within half the radius of
it (65 for radius 2, 2,081 for 4); two are within the radius exactly if they share such a value, and the smallest stands for all that do.
So rows grow with the fingerprints, not with their square, and no link is lost.

Defined cases: null and wordless texts have fingerprint 0 and link like any other. Texts of fewer words than a shingle have one, their
whole sequence. Repeated rows are separate rows of one node. A null id never is a component's smallest id, unless the component has
no other. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import P, drop_table, joined, lower_ascii, materialise, named, packed, unpacked, utf8, word_bounds
from lakeseek.llm.graph import components


def _lanes() -> np.ndarray:
    """For each value of four bits its bits as four 16-bit counters in one word."""
    return np.array([sum((v >> k & 1) << 16 * k for k in range(4)) for v in range(16)], np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each run of ``sizes`` hashes: a bit is 1 if set in over half of them; 0 for an empty run."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    pieces = np.maximum(1, -(-sizes // most))  # a counter of 16 bits holds so many
    first = np.repeat(starts, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    owner = np.repeat(np.arange(len(sizes)), pieces)
    some = np.repeat(sizes > 0, pieces)
    first, owner = first[some], owner[some]
    out = np.zeros(len(sizes), np.uint64)
    if not len(first):
        return out
    lanes = _lanes()
    for nibble in range(16):
        packed = np.add.reduceat(lanes[((hashes >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.intp)], first)
        for k in range(4):
            counts = np.bincount(owner, ((packed >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64), len(sizes))
            out |= (counts * 2 > sizes).astype(np.uint64) << np.uint64(4 * nibble + k)
    return out


def shingle_hashes(column, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of an Arrow string column, and the number of each text's shingles."""
    import xxhash

    raw, off = utf8(column)
    raw = lower_ascii(raw)
    starts, ends, offs = word_bounds(raw, off)
    text, _ = joined(raw, starts, ends, offs)
    words = np.diff(offs)
    length = ends - starts
    doc = np.repeat(np.arange(len(words)), words)
    last = np.zeros(len(starts), bool)
    last[offs[1:][words > 0] - 1] = True
    begin = np.concatenate([[0], np.cumsum(length + ~last)])[:-1].astype(np.int64)
    end = begin + length
    at = np.arange(len(starts))
    rank = at - offs[:-1][doc] if len(at) else at
    size = np.minimum(shingle, words[doc]) if len(at) else at
    ok = rank + size <= words[doc] if len(at) else np.zeros(0, bool)
    ok &= (words[doc] >= shingle) | (rank == 0) if len(at) else ok
    lo = begin[ok]
    hi = end[at[ok] + size[ok] - 1] if len(at) else lo
    digest, data = xxhash.xxh64_intdigest, text.tobytes()
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
    return hashes, np.where(words == 0, 0, np.maximum(1, words - shingle + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, with_hash: bool = False) -> DataFrame:
    """(P + id, P + fp bigint) of every row, and the text's xxhash64 as P + t if asked; fp has the bits of the unsigned fingerprint."""
    id_type = docs.schema[id_col].dataType.simpleString()
    more = [P + "t"] * with_hash

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, sizes = shingle_hashes(part.column(P + "text"), shingle, seed)
                yield pa.record_batch([part.column(P + "id"), pa.array(majority(hashes, sizes).view(np.int64)), *[part.column(c) for c in more]], [P + "id", P + "fp", *more])

    text = named(text_col)
    rows = docs.select(named(id_col).alias(P + "id"), text.alias(P + "text"), *[F.xxhash64(text).alias(c) for c in more])
    return rows.mapInArrow(compute, f"`{P}id` {id_type}, `{P}fp` bigint" + f", `{P}t` bigint" * with_hash)


def links(prints: DataFrame, hot: int = 32, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``prints`` (fp bigint) whose components are those of all pairs within ``radius`` bits.

    No join is left to the planner: it sees the size of a compressed file, not what the rows unfold to (35 keys, 2,081 near values).
    A node of a hot key's value may be no fingerprint of a row; it joins only fingerprints that are linked anyway.
    """
    if radius % 2:
        raise ValueError("the radius must be even: hot keys meet at half of it")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1})" for a, b in zip(edges, edges[1:])]
    keys = [f"struct({i} AS c, xxhash64({', '.join(block[j] for j in own)}) AS k)" for i, own in enumerate(combinations(range(blocks), blocks - radius))]
    dealt = prints.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")).select("fp", "key.c", "key.k")
    counted = dealt.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(dealt.join(counted.hint("merge"), ["c", "k"]), "blocks")
    small = met.filter(F.col("n") <= hot)
    pairs = (
        small.select("c", "k", F.col("fp").alias("u")).join(small.select("c", "k", F.col("fp").alias("v")).hint("merge"), ["c", "k"])
        .filter((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")
    )
    masks = [sum(1 << b for b in bits) for r in range(radius // 2 + 1) for bits in combinations(range(64), r)]
    signed = " ".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)
    near = F.transform(F.split(F.lit(signed), " "), lambda m: F.col("fp").bitwiseXOR(m.cast("long")))  # one literal, whatever the radius
    close = met.filter(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(near).alias("mid"))
    least = close.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = close.join(least.hint("merge"), "mid").select(F.col("fp").alias("u"), "v").filter("u <> v")
    out = materialise(pairs.unionByName(shared).distinct(), "links")
    drop_table(met)
    return out


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, hot: int = 32, radius: int = 2, blocks: int = 4, by_text: bool = False,
) -> DataFrame:
    """(P + id, P + fp, P + component) of every row: component is the smallest id reachable over links of ``radius`` bits or fewer.

    ``by_text`` adds P + t, the text's hash, and P + first, whether no row of the component has a smaller (id, hash of the text).
    """
    columns = [P + "id", P + "fp"] + [P + "t"] * by_text
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed, by_text), "fingerprints")
    own = F.struct(F.col(P + "id").isNull().alias("none"), F.col(P + "id").alias("id"), F.col(P + "t").alias("t")) if by_text else F.lit(None).cast("int")
    groups = materialise(prints.groupBy(F.col(P + "fp").alias("fp")).agg(F.min(P + "id").alias("least"), F.min(own).alias("own")), "distinct-fingerprints")
    edges = links(groups.select("fp"), hot, radius, blocks)
    roots = components(edges)
    rooted = groups.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias(P + "component"), F.min("own").alias("first"))
    known = rooted.join(least.hint("merge"), "root").select(F.col("fp").alias(P + "fp"), P + "component", "first")
    out = prints.join(known.hint("merge"), P + "fp")
    drop_table(edges)
    return out.select(*columns, P + "component", *([own.eqNullSafe(F.col("first")).alias(P + "first")] if by_text else []))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, blocks: int = 7, hot: int = 1024) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: that of the smallest id, of equal ids that of the smallest hash of the text.

    Rows are told apart by id and text, so an id with several texts loses only those that are near others; of fully equal rows one stays.
    Texts are near at ``radius`` bits of 64 or fewer over shingles of five words. An empty table gives an empty result.
    """
    found = simhash_components(docs, id_col, text_col, shingle, hot=hot, radius=radius, blocks=blocks, by_text=True)
    first = found.filter(P + "first").select(F.col(P + "id").alias("first_id"), F.col(P + "t").alias("first_text")).distinct()
    rows = packed(docs, id=named(id_col), t=F.xxhash64(named(text_col)))
    kept = rows.join(first.hint("merge"), F.col(P + "id").eqNullSafe(F.col("first_id")) & (F.col(P + "t") == F.col("first_text")), "left_semi")
    one = kept.groupBy(P + "id", P + "t").agg(F.first(P + "row").alias(P + "row"))
    return one.select(*unpacked(one, docs.columns))
