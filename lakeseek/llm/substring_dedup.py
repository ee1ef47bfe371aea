"""Substring dedup by level-wise doubling.

Windows of words are looked for at growing lengths; only what repeats at one length is extended to (about) twice it:

* level 1, a quarter of the window (9 of 35 words): of every full window only its smallest short hash counts (winnowing), so any
  two equal full windows pick the same short window, and a few per cent of the positions are sent;
* level 2, half (18): the halves to the left and right of each surviving short window, and its whole surroundings. Surroundings
  that repeat prove every full window in them a repeat at once, so only one copy has to go on;
* level 3, the full length: the windows around surviving halves, each hashed and counted.

Doubling ends at the contract's length: longer repeats cover no other words. Level 1 only finds candidates and hashes with 64 bits; levels
2 and 3 decide, with 128 bits: two hashes over independent word hashes.

Texts are dealt once into groups of about a megabyte, larger ones where there would be more than ``most_groups``; all levels and the cut
itself read that one exchange. Between levels only (hash, group) pairs travel, each once per group, so a passage shared by a third of all
rows costs one row per group: at most ``most_groups`` rows of some 30 bytes are ever brought together for one hash.

Defined cases: a null text counts as empty (no words; the hash of the empty string). Texts shorter than the window lose nothing.
Rows with the same doc_id, even equal rows, are separate texts: equal long rows remove each other's words entirely, as any
repeated window does. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import _M2, _M3, P, group_count, joined, named, utf8, window_hashes, word_bounds, word_hashes, word_sums

Hashes = tuple[np.ndarray, np.ndarray]  # 128 bits in two halves

SHORT, HALF = 1, 2  # salts of the levels
SURROUNDINGS, FULL = 3, 4


def _lengths(window: int) -> tuple[int, int]:
    half = max(1, (window + 1) // 2)
    return max(1, (half + 1) // 2), half


def _sliding(values: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """op over values[i : i + width] for every i, what lies beyond the end as ``fill``; by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full(len(values), fill, np.uint64)
        shifted[: max(0, len(values) - step)] = out[step:]
        out, have = op(out, shifted), have + step
    return out


class Group:
    """The texts of one group as arrays of words, with the windows of every level."""

    def __init__(self, texts, window: int):
        self.window = window
        self.short, self.half = _lengths(window)
        self.raw, off = utf8(texts)
        self.starts, self.ends, self.offs = word_bounds(self.raw, off)
        self.words = word_hashes(self.raw, self.starts, self.ends)
        n = len(self.words)
        self.prefix = word_sums(self.words)
        sizes = np.diff(self.offs)
        self.lo, self.hi = np.repeat(self.offs[:-1], sizes), np.repeat(self.offs[1:], sizes)  # of each word's text
        self.at = np.arange(n)
        self.full = self.at + window <= self.hi  # a full window starts here
        self._second: Hashes | None = None

    def second_words(self) -> Hashes:
        """Word hashes independent of the first, and their prefix sums."""
        if self._second is None:
            words = word_hashes(self.raw, self.starts, self.ends, 1)
            self._second = words, word_sums(words, _M3)
        return self._second

    def hashes(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
        return window_hashes(self.words, lo, hi, salt, self.prefix, _M2)

    def wide(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> Hashes:
        words, prefix = self.second_words()
        return self.hashes(lo, hi, salt), window_hashes(words, lo, hi, salt, prefix, _M3)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the short windows that are the smallest of some full window (all of them on a tie), and their hashes."""
        if not self.full.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(len(self.words), np.iinfo(np.uint64).max, np.uint64)
        fits = np.flatnonzero(self.at + self.short <= self.hi)
        h[fits] = self.hashes(fits, fits + self.short, SHORT)
        width = self.window - self.short + 1
        least = _sliding(h, width, np.minimum, int(np.iinfo(np.uint64).max))
        least[~self.full] = 0
        most = _sliding(least[::-1], width, np.maximum, 0)[::-1]  # over the full windows that hold this short one
        at = np.flatnonzero((most == h) & (most > 0))
        return at, h[at]

    def second(self, at: np.ndarray) -> tuple[np.ndarray, Hashes, np.ndarray, Hashes, Hashes]:
        """Which anchors have a half to the right, its hashes, the same to the left, and hashes of all anchors' surroundings."""
        back = self.half - self.short
        right = at[at + self.half <= self.hi[at]]
        left = at[at - back >= self.lo[at]]
        reach = self.window - self.short
        first, last = np.maximum(at - reach, self.lo[at]), np.minimum(at + self.window, self.hi[at])
        place = (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = self.wide(first, last, SURROUNDINGS)
        return right, self.wide(right, right + self.half, HALF), left, self.wide(left - back, left - back + self.half, HALF), (a ^ place, b)

    def marked(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which starts of full windows lie in any of the ranges [first, last]."""
        edge = np.zeros(len(self.words) + 2, np.int32)
        ok = first <= last
        np.add.at(edge, first[ok], 1)
        np.add.at(edge, last[ok] + 1, -1)
        return (np.cumsum(edge)[: len(self.words)] > 0) & self.full

    def around(self, at: np.ndarray) -> np.ndarray:
        """Full windows that hold one of these short windows."""
        reach = self.window - self.short
        return self.marked(np.maximum(at - reach, self.lo[at]), np.minimum(at, self.hi[at] - self.window))

    def beside(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Full windows that hold the half to the right of one of ``right`` or to the left of one of ``left``."""
        back, over = self.half - self.short, self.window - self.half
        a = (np.maximum(right - over, self.lo[right]), right)
        b = (np.maximum(left - back - over, self.lo[left]), left - back)
        return self.marked(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


class Told:
    """Repeated hashes as a group was told them, and which of them it stands for."""

    def __init__(self, table):
        h, w = (table.column(c).to_numpy().view(np.uint64) for c in (P + "h", P + "w"))
        order = np.lexsort((w, h))
        self.h, self.w = h[order], w[order]
        self.mine = table.column(P + "mine").to_numpy(zero_copy_only=False).astype(bool)[order]

    def has(self, hashes: Hashes, mine: bool = False) -> np.ndarray:
        h, w = hashes
        out = np.zeros(len(h), bool)
        if len(self.h):
            at, end = np.searchsorted(self.h, h), np.searchsorted(self.h, h, side="right")
            while (more := at < end).any():  # nearly always one round: equal first halves are equal hashes
                where = np.minimum(at, len(self.h) - 1)
                out |= more & (self.w[where] == w) & (self.mine[where] if mine else True)
                at = at + 1
        return out


def _rows(group: int, hashes: list[Hashes]):
    import pyarrow as pa

    h, w = (np.concatenate([x[i] for x in hashes]) for i in (0, 1))
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    return pa.table({P + "h": h[first].view(np.int64), P + "w": w[first].view(np.int64), P + "g": np.full(len(first), group, np.int32), P + "n": np.minimum(n, 2).astype(np.int8)})


def _repeated(sent: DataFrame) -> DataFrame:
    """Of (hash, group, count) the pairs whose hash occurs twice or more, and whether the group is the first to have it."""
    own = Window.partitionBy(P + "h", P + "w")
    seen = sent.select("*", F.sum(P + "n").over(own).alias(P + "c"), F.min(P + "g").over(own).alias(P + "m"))
    return seen.filter(F.col(P + "c") > 1).select(P + "h", P + "w", P + "g", (F.col(P + "g") == F.col(P + "m")).alias(P + "mine"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False, most_groups: int = 1 << 22) -> DataFrame:
    """Per text: id, n_words, n_removed, kept_sha256, spans (removed runs [first word, one past the last]) and, if asked, kept_text.

    A word goes if a window of ``window`` words covers it whose sequence also starts anywhere else.
    """
    groups = min(group_count(docs, text_col), most_groups)
    own_id, own_text = named(id_col), named(text_col)
    dealt = docs.select(F.pmod(F.xxhash64(own_id, own_text), F.lit(groups)).cast("int").alias(P + "g"), own_id.alias(P + "id"), own_text.alias(P + "t"))
    sent_type = f"`{P}h` bigint, `{P}w` bigint, `{P}g` int, `{P}n` tinyint"

    def level1(key, texts):
        _, h = Group(texts.column(P + "t"), window).anchors()
        return _rows(key[0].as_py(), [(h, np.zeros(len(h), np.uint64))])

    def level2(key, texts, told):
        group = Group(texts.column(P + "t"), window)
        at, h = group.anchors()
        _, right, _, left, around = group.second(at[Told(told).has((h, np.zeros(len(h), np.uint64)))])
        return _rows(key[0].as_py(), [right, left, around])

    def judged(group: Group, told: Told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows proven to repeat, windows of which that is this group's to send on, and windows still open."""
        at, _ = group.anchors()
        right, right_hash, left, left_hash, around = group.second(at)
        certain = group.around(at[told.has(around)])
        first = group.around(at[told.has(around, mine=True)])
        open_ = group.beside(right[told.has(right_hash)], left[told.has(left_hash)]) & ~certain
        return certain, first, open_

    def level3(key, texts, told):
        group = Group(texts.column(P + "t"), window)
        _, first, open_ = judged(group, Told(told))
        at = np.flatnonzero(first | open_)
        return _rows(key[0].as_py(), [group.wide(at, at + window, FULL)])

    def cut(key, texts, told):
        import pyarrow as pa

        group = Group(texts.column(P + "t"), window)
        full = told.column(P + "full").to_numpy(zero_copy_only=False).astype(bool)
        certain, _, open_ = judged(group, Told(told.filter(pa.array(~full))))
        at = np.flatnonzero(open_)
        hit = certain
        hit[at[Told(told.filter(pa.array(full))).has(group.wide(at, at + window, FULL))]] = True
        edge = np.zeros(len(hit) + window + 1, np.int32)
        edge[np.flatnonzero(hit)] += 1
        edge[np.flatnonzero(hit) + window] -= 1
        gone = np.cumsum(edge)[: len(hit)] > 0
        raw, offs = joined(group.raw, group.starts, group.ends, group.offs, ~gone)
        data = raw.tobytes()
        n = np.diff(group.offs)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[group.offs])
        parts = [data[offs[i] : offs[i + 1]] for i in range(len(n))]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        runs = [[] for _ in n]
        for a, b in zip(turn[::2], turn[1::2]):
            while a < b:  # a run of removed words may go on into the next text
                i = int(np.searchsorted(group.offs, a, side="right")) - 1
                stop = min(b, group.offs[i + 1])
                runs[i].append([int(a - group.offs[i]), int(stop - group.offs[i])])
                a = stop
        out = {
            id_col: texts.column(P + "id"), "n_words": n.astype(np.int64), "n_removed": removed.astype(np.int64),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in parts], "spans": pa.array(runs, pa.list_(pa.list_(pa.int32()))),
        }
        if with_text:
            out["kept_text"] = [x.decode("utf-8", "replace") for x in parts]
        return pa.table(out)

    by = dealt.groupBy(P + "g")
    one = _repeated(by.applyInArrow(level1, sent_type))
    two = _repeated(by.cogroup(one.groupBy(P + "g")).applyInArrow(level2, sent_type))
    three = _repeated(by.cogroup(two.groupBy(P + "g")).applyInArrow(level3, sent_type))
    told = two.withColumn(P + "full", F.lit(False)).unionByName(three.withColumn(P + "full", F.lit(True)))
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<int>>" + ", kept_text string" * with_text
    return by.cogroup(told.groupBy(P + "g")).applyInArrow(cut, kept)
