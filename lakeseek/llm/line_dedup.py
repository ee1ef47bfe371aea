"""Line dedup over overlapping three-line windows.

Every window of consecutive lines is hashed (two 64-bit hashes, 128 bits in all). Of the places of a repeated window the first, by
(doc_id, hash of the text, line), stays; at every later place its lines are covered, and the covered lines of a text, merged over
overlapping windows, go. Counts are partial before the shuffle; the join that brings a common window to its places has the places on
its large side, which adaptive execution splits.

Defined cases: a null text stays null with 0 lines. Texts of fewer lines than a window lose nothing. Windows of blank lines only are
no windows. Lines are compared as they are, without the newline. Fully equal rows (same id, same text) count as one text and share
its decision; rows of one id with different texts are separate. A null id is an id of its own, the smallest. An empty table gives an
empty result. Other columns, whatever their names, are kept as they are, but for two of the results' own names, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import SPACES, P, materialise, named, packed, unpacked


def _windows(text: Column, width: int) -> Column:
    def of(lines: Column) -> Column:
        def window(i: Column) -> Column:
            own = [F.element_at(lines, (i + F.lit(k)).cast("int")) for k in range(1, width + 1)]
            return F.struct(
                i.cast("int").alias("pos"),
                F.xxhash64(*own).alias("h1"),
                F.xxhash64(F.lit(width), *own[::-1]).alias("h2"),
                (F.translate(F.concat(*own), SPACES, "") != "").alias("filled"),
            )

        last = F.size(lines) - F.lit(width)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, window), lambda x: x["filled"])

    # bound as a lambda's variable, so that the text is split once
    return F.element_at(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n", -1)), of), 1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text hash, covered): the line numbers, from 0, that go from each text that loses any."""
    hits = materialise(
        docs.select(named(id_col).alias(P + "id"), F.xxhash64(named(text_col)).alias(P + "t"), F.explode(_windows(named(text_col), width)).alias(P + "w"))
        .select(P + "id", P + "t", P + "w.pos", P + "w.h1", P + "w.h2"),
        "line-windows",
    )
    place = F.struct(P + "id", P + "t", "pos")
    first = hits.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = hits.join(first.hint("merge"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + F.lit(width - 1)))))
    return later.groupBy(P + "id", P + "t").agg(covered.alias(P + "covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the text cut to the lines that stay, and n_lines and n_removed_lines as columns of the names P + these (in place of any such)."""
    gone = repeated_lines(docs, id_col, text_col, width).withColumnsRenamed({P + "id": P + "gid", P + "t": P + "gt"})
    text, covered = F.col(P + "text"), F.col(P + "covered")
    keyed = packed(docs, id=named(id_col), text=named(text_col), t=F.xxhash64(named(text_col)))
    both = keyed.join(gone.hint("merge"), F.col(P + "id").eqNullSafe(F.col(P + "gid")) & (F.col(P + "t") == F.col(P + "gt")), "left")

    def cut(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.array_join(F.transform(at, lambda i: F.element_at(lines, i + 1)), "\n")

    kept = F.when(covered.isNull(), text).otherwise(F.element_at(F.transform(F.array(F.split(text, "\n", -1)), cut), 1))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    added = [P + "n_lines", P + "n_removed_lines"]
    own = [c for c in docs.columns if c not in added]
    return both.select(
        *[kept.alias(c) if c == text_col else column for c, column in zip(own, unpacked(both, own))],
        n_lines.cast("long").alias(added[0]), F.when(covered.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias(added[1]),
    )
