"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A paragraph is a line. Its leaves are content-defined runs of about seven words, cut by its own words alone; they tile it, its first leaf from its
first byte, every other from its first word up to the next one. A section ends at a blank paragraph, or after one whose digest falls in
one of eight classes, so that an edit moves no borders far from it. A leaf's digest is the SHA-256 of its bytes, a paragraph's that of its
leaves' digests, a section's that of its paragraphs', the root's that of its sections'. So equal roots mean equal texts, and going down
where branches differ finds the edited sections, paragraphs and leaves.

fingerprint = root (64 hex digits) "." sections joined by ","; a section = 8 hex digits of its digest, then for each paragraph ":" and 8 hex
digits of its digest and its leaves' first 24 bits, four base64 characters each. All comparisons work on two such strings.

``likeness`` is 1 for equal roots. Else it goes down the two trees: branches with equal digests are alike whole, whatever they hold; of the
other sections the paragraphs are compared, of the other paragraphs the leaves. It is twice the leaves in alike branches over all leaves.

Defined cases: a null text counts as empty: one section of one empty paragraph with one leaf. Two empty texts have likeness 1. Rows of
one id are in the order of their texts. With a single row the next document is the row itself. Null ids come last. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import P, mix, named, shuffle_partitions, size_bytes, utf8, word_bounds, word_hashes

PART_BYTES, MOST_PARTS = 1 << 27, 100_000  # of the ids' ranges


def leaf_starts(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow column, the texts' offsets in them, and where leaves other than a paragraph's first start."""
    raw, off = utf8(texts)
    starts, ends, offs = word_bounds(raw, off)
    n = len(starts)
    if n < 2:
        return raw, off, np.zeros(0, np.int64)
    h = mix(word_hashes(raw, starts, ends) ^ np.uint64(0x5851F42D4C957F2D))
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    own = newline[starts] + np.repeat(np.arange(len(offs) - 1), np.diff(offs))  # a number for each paragraph
    least, most = h.copy(), np.iinfo(np.uint64).max
    for k in range(1, 4):
        same = own[k:] == own[:-k]
        least[k:] = np.minimum(least[k:], np.where(same, h[:-k], most))
        least[:-k] = np.minimum(least[:-k], np.where(same, h[k:], most))
    # the word after a local minimum starts a leaf, unless it starts a paragraph
    return raw, off, starts[1:][(h == least)[:-1] & (own[1:] == own[:-1])]


def trees(texts) -> list[tuple[str, list]]:
    """Of each text the root and the sections: (digest, [(paragraph's digest, leaves' 24 bits as bytes)])."""
    raw, off, cuts = leaf_starts(texts)
    data, sha = raw.tobytes(), hashlib.sha256
    out = []
    first = np.searchsorted(cuts, off)
    for i in range(len(off) - 1):
        at, end = int(off[i]), int(off[i + 1])
        own = cuts[first[i] : first[i + 1]].tolist()
        k, root, sections, paragraphs, node = 0, sha(), [], [], sha()
        while at <= end:
            stop = data.find(b"\n", at, end)
            stop = end if stop < 0 else stop
            paragraph, leaves, lo = sha(), [], at
            while k < len(own) and own[k] < stop:
                digest = sha(data[lo : own[k]]).digest()
                paragraph.update(digest)
                leaves.append(digest[:3])
                lo = own[k]
                k += 1
            digest = sha(data[lo:stop]).digest()
            paragraph.update(digest)
            leaves.append(digest[:3])
            digest = paragraph.digest()
            node.update(digest)
            paragraphs.append((digest, b"".join(leaves)))
            if digest[4] & 7 == 0 or stop == end or not data[at:stop].strip():
                sections.append((node.digest(), paragraphs))
                root.update(node.digest())
                paragraphs, node = [], sha()
            at = stop + 1
        out.append((root.hexdigest(), sections))
    return out


def fingerprint(tree: tuple[str, list]) -> str:
    root, sections = tree
    return f"{root}." + ",".join(
        section[:4].hex() + "".join(f":{digest[:4].hex()}{base64.b64encode(leaves).decode()}" for digest, leaves in paragraphs) for section, paragraphs in sections
    )


def parsed(print_: str) -> tuple[str, list]:
    """Root, and the sections as (digest, [(paragraph's digest, leaves)]), digests being the strings of the fingerprint."""
    root, _, rest = print_.partition(".")
    sections = []
    for section in rest.split(","):
        digest, *paragraphs = section.split(":")
        sections.append((digest, [(p[:8], base64.b64decode(p[8:])) for p in paragraphs]))
    return root, sections


def _unlike(a: list, b: list) -> tuple[list, list]:
    """The branches (digest first) of each side that the other has no equal of, as multisets."""
    if len(a) == len(b) == 1:
        return ([], []) if a[0][0] == b[0][0] else (a, b)
    mine, theirs = Counter(x[0] for x in a), Counter(x[0] for x in b)
    out = []
    for branches, other in ((a, theirs), (b, mine)):
        left, rest = dict(other), []
        for x in branches:
            if left.get(x[0], 0):
                left[x[0]] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def _leaves(sections: list) -> int:
    return sum(len(leaves) for _, paragraphs in sections for _, leaves in paragraphs) // 3


def tree_likeness(a: tuple[str, list], b: tuple[str, list]) -> float:
    if a[0] == b[0]:
        return 1.0
    total = _leaves(a[1]) + _leaves(b[1])
    rest_a, rest_b = _unlike(a[1], b[1])
    rest_a, rest_b = _unlike([p for s in rest_a for p in s[1]], [p for s in rest_b for p in s[1]])
    split = lambda rest: Counter(leaves[i : i + 3] for _, leaves in rest for i in range(0, len(leaves), 3))
    left_a, left_b = split(rest_a), split(rest_b)
    unlike = sum((left_a - left_b).values()) + sum((left_b - left_a).values())
    return (total - unlike) / total


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    return 1.0 if a[:64] == b[:64] else tree_likeness(parsed(a), parsed(b))


def edited_branches(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` whose digests ``a`` lacks; sections that ``a`` has whole are not gone into."""
    if a[:64] == b[:64]:
        return []
    old, new = parsed(a)[1], parsed(b)[1]
    whole, known = {s for s, _ in old}, {p for _, paragraphs in old for p, _ in paragraphs}
    return [(i, j) for i, (s, paragraphs) in enumerate(new) if s not in whole for j, (p, _) in enumerate(paragraphs) if p not in known]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row in a part of the ids' descending order, and again, as the row to look at, at the end of the part before.

    A part is a task's own; there are as many as the table's bytes ask for, and a task streams through its part in order.
    """
    n = min(MOST_PARTS, max(4 * shuffle_partitions(docs.sparkSession), math.ceil(size_bytes(docs, text_col) / PART_BYTES)))
    own_id = named(id_col)
    row = docs.agg(F.percentile_approx(own_id, F.array(*[F.lit(k / n) for k in range(1, n + 1)]), F.lit(max(10_000, 20 * n))), F.max(own_id)).first()
    # ids that are there, descending: each starts a part; the first is the largest
    bounds = sorted({row[1], *(row[0] or [])} - {None}, reverse=True)
    step = max(1, math.isqrt(len(bounds)))
    rows = docs.select(own_id.alias(P + "id"), named(text_col).alias(P + "t"))
    if bounds:
        fine, coarse = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[::step]])
        first = F.size(F.filter(coarse, lambda b: b >= F.col(P + "id")))
        at = F.greatest(F.lit(0), (first - 1) * step)
        part = F.when(F.col(P + "id").isNull(), F.lit(len(bounds) - 1)).otherwise(at + F.size(F.filter(F.slice(fine, (at + 1).cast("int"), step), lambda b: b >= F.col(P + "id"))) - 1)
        starts = F.array_contains(fine, F.col(P + "id"))
    else:
        part, starts = F.lit(0), F.lit(True)
    rows = rows.withColumn(P + "p", part.cast("int"))
    before = F.when(F.col(P + "p") == 0, F.lit(max(0, len(bounds) - 1))).otherwise(F.col(P + "p") - 1)
    own = F.struct(F.col(P + "p").alias("p"), F.lit(False).alias("peek"))
    both = F.array(own, F.struct(before.cast("int").alias("p"), F.lit(True).alias("peek")))
    out = rows.select(P + "id", P + "t", F.explode(F.when(starts, both).otherwise(F.array(own))).alias("x")).select(P + "id", P + "t", F.col("x.p").alias(P + "p"), F.col("x.peek").alias(P + "peek"))
    return out.repartitionById(n, F.col(P + "p")).sortWithinPartitions(P + "p", P + "peek", F.col(P + "id").desc_nulls_last(), P + "t")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint of the text and of its edited text (the last half replaced by the start of the next document), likenesses.

    Texts are shuffled once, in ranges of the ids; each task streams through its sorted rows and holds one row back.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            """rows: (id, text, next text)."""
            texts = [t for _, t, _ in rows]
            edited, after = [], []
            for i, (_, text, following) in enumerate(rows):
                half = len(text) // 2
                edited.append(text[: len(text) - half] + following[:half])
                if i + 1 == len(rows) or rows[i + 1][1] is not following:  # the next row's tree is known
                    after.append((i, following))
            grown = trees(pa.array(texts + edited + [f for _, f in after], pa.large_string()))
            n = len(rows)
            following = grown[1:n] + [None]
            for (i, _), tree in zip(after, grown[2 * n :]):
                following[i] = tree
            return pa.record_batch({
                id_col: pa.array([r[0] for r in rows], batch.schema.field(P + "id").type), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited], "fingerprint": [fingerprint(t) for t in grown[:n]],
                "edited_fingerprint": [fingerprint(t) for t in grown[n : 2 * n]],
                "near_edited": pa.array([tree_likeness(a, b) for a, b in zip(grown[:n], grown[n : 2 * n])], pa.float64()),
                "near_next": pa.array([tree_likeness(a, b) for a, b in zip(grown[:n], following)], pa.float64()),
            })

        held, done, ready, size = None, False, [], 0
        for batch in batches:
            for p, peek, i, text in zip(*(batch.column(P + c).to_pylist() for c in ("p", "peek", "id", "t"))):
                text = text or ""
                if held and held[0] == p and not done:
                    ready.append((held[1], held[2], text))
                    size += len(held[2]) + len(text)
                if peek:
                    done = True  # the first row to look at closes the part
                else:
                    held, done = (p, i, text), False
                if size > 1 << 20:
                    yield emit(ready)
                    ready, size = [], 0
        if ready:
            yield emit(ready)

    kept = f"`{id_col}` {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs, id_col, text_col).mapInArrow(run, kept)
