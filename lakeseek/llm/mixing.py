"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power alpha, normalised. Alpha is found by bisection: the largest alpha (closest
to the natural shares) at which the weights' entropy reaches ``target_entropy`` of the largest possible, or, with
``max_repetition``, the smallest at which no source is read more often than that; where both are given both hold, the repetition limit first. The
weights times the token budget are the sources' budgets. Where no alpha can hold the repetition limit (a budget of more than that many
times all tokens), budgets are cut to it and the mix is smaller than asked; nothing is dealt to other sources instead.

A budget is realised as passes over permuted blocks: documents fall by hash into their source's blocks of about ``block_tokens`` tokens,
as many blocks as the counted tokens ask for; every pass takes its source's blocks in the order of a hash of (seed, pass, block), and inside
a block its documents by a hash of (seed, pass, document). Whole passes take everything; the last pass takes blocks up to the budget, and
of the block that crosses it the documents up to it. A source gets its budget to within one document. ``order_key`` (0 to 1) places every
taken block in the whole mix, ``doc_key`` a document in its block: sorted by (order_key, source, block, doc_key), sources interleave in
proportion at any point of the mix.

The texts are read twice: to count each document's tokens (kept as one small row a document, from which all sums come) and to take the
documents. A source's decision is a few numbers in one row, joined back by broadcast while there are at most ``broadcast_rows`` sources,
shuffled otherwise; then alpha is bisected on distributed sums too. No text moves. The block where a budget ends is found in three steps,
each a running sum over few rows of a source: over ``RANGES`` equal ranges of the blocks' order, over the blocks of the one range that
crosses, over the documents of the one block.

Defined cases: a null source is a source of its own. A null or wordless text has 0 tokens; it comes with its block in whole passes.
A corpus without tokens gets every row once. Equal rows are hashed alike and taken together. An empty table gives an empty result. New
columns whose name the input has already get "new_" before theirs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import P, drop_table, free_name, materialise, named, native_words, packed, unpacked

SPAN = 1 << 62  # hashes are used as numbers from 0 up to this
RANGES = 1 << 12  # of a source's block order


def weights(shares: list[float], alpha: float) -> list[float]:
    raw = [s**alpha if s > 0 else 0.0 for s in shares]
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


#: For an alpha the sums over sources with tokens of x and of x * log(share), x the share to the power alpha.
Moments = Callable[[float], tuple[float, float]]


def moments_of(shares: list[float]) -> Moments:
    some = [s for s in shares if s > 0]
    return lambda alpha: (math.fsum(s**alpha for s in some), math.fsum(s**alpha * math.log(s) for s in some))


def bisect_alpha(moments: Moments, sources: int, least_share: float, budget_share: float, target_entropy: float | None, max_repetition: float | None, steps: int = 60) -> float:
    """Alpha in [0, 1]. Entropy falls and the largest repetition, which is the smallest source's, falls as alpha grows, so both borders are found by bisection."""

    def border(holds) -> float:
        """The largest alpha at which ``holds``, which is true at small alphas; 0 if at none, 1 if at all."""
        if holds(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    def spread(alpha: float) -> float:
        z, s = moments(alpha)
        return math.log(z) - alpha * s / z

    def over(alpha: float) -> bool:
        return least_share ** (alpha - 1) * budget_share / moments(alpha)[0] > max_repetition

    alpha = 1.0
    if target_entropy is not None and sources > 1:
        alpha = border(lambda a: spread(a) >= target_entropy * math.log(sources))
    if max_repetition is not None and over(alpha):
        alpha = max(alpha, border(over))
    return alpha


def solve_alpha(tokens: list[int], budget: float, target_entropy: float | None, max_repetition: float | None) -> float:
    total = sum(tokens)
    shares = [t / total for t in tokens if t]
    return bisect_alpha(moments_of(shares), len(shares), min(shares), budget / total, target_entropy, max_repetition)


def _hash(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def _crossing(rows: DataFrame, key: list[str], order: list[str], amount: str, left: str) -> DataFrame:
    """Of each ``key`` the first row in ``order`` with which the running sum of ``amount`` exceeds ``left``, with what it still may take as ``left``."""
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = rows.withColumn("upto", F.sum(amount).over(running)).filter(F.col("upto") > F.col(left))
    first = F.min_by(F.struct(*order, (F.col(left) - F.col("upto") + F.col(amount)).alias("left")), F.struct(*order))
    return over.groupBy(*key).agg(first.alias("cut"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.98, max_repetition: float | None = 4.0,
    budget_share: float = 1.0, block_tokens: int = 50_000, seed: int = 17, broadcast_rows: int = 100_000, keep: list[str] | None = None,
) -> DataFrame:
    """The taken rows: ``keep`` (by default the input's columns), n_tokens, epoch, block, order_key, doc_key. The budget is ``budget_share`` of all tokens."""
    keep = docs.columns if keep is None else keep
    tokens = F.size(native_words(named(text_col))).cast("long")
    row_hash = F.xxhash64(F.lit(seed), named(id_col), named(text_col))
    counted = materialise(docs.select(named(source_col).alias("s"), row_hash.alias("r"), tokens.alias("n")), "mix-tokens")
    totals = materialise(counted.groupBy("s").agg(F.sum("n").alias("total")), "mix-sources")
    whole = totals.agg(F.count("*"), F.sum("total"), F.min(F.when(F.col("total") > 0, F.col("total"))), F.count_if(F.col("total") > 0)).first()
    few, all_tokens = whole[0] <= broadcast_rows, whole[1] or 0
    alpha = norm = 1.0
    if all_tokens:
        share = F.col("total") / F.lit(all_tokens)
        if few:
            moments = moments_of([r[0] / all_tokens for r in totals.select("total").collect()])
        else:
            some = totals.filter("total > 0").select(share.alias("x"))

            def moments(a: float) -> tuple[float, float]:
                power = F.pow("x", F.lit(a))
                return tuple(some.agg(F.sum(power), F.sum(power * F.log("x"))).first())

        alpha = bisect_alpha(moments, whole[3], whole[2] / all_tokens, budget_share, target_entropy, max_repetition)
        norm = moments(alpha)[0]
    total = F.col("total")
    weight = F.when(total > 0, F.pow(total / F.lit(max(1, all_tokens)), F.lit(alpha)) / F.lit(norm)).otherwise(F.lit(0.0))
    budget = F.when(total > 0, weight * F.lit(budget_share * all_tokens)).otherwise(F.lit(0.0))
    if max_repetition is not None:
        budget = F.least(budget, total * F.lit(float(max_repetition)))
    plan = totals.select("s", "total", F.greatest(F.lit(1), F.ceil(total / F.lit(block_tokens))).cast("long").alias("blocks"), budget.alias("budget"))
    passes = F.when(total > 0, F.floor(F.col("budget") / total + F.lit(1e-12))).otherwise(F.lit(1)).cast("long")
    plan = plan.withColumn("whole", passes)
    plan = plan.withColumn("rest", F.when(total > 0, F.col("budget") - F.col("whole") * total).otherwise(F.lit(0.0)))

    def by_source(left: DataFrame, right: DataFrame, key: str = "s") -> DataFrame:
        right = right.withColumnRenamed("s", "of")
        return left.join(F.broadcast(right) if few else right.hint("merge"), left[key].eqNullSafe(right["of"])).drop("of")

    # the last pass: the range of the order that crosses the budget, in it the block, in that the documents
    blocks = by_source(counted, plan).withColumn("block", F.pmod("r", "blocks")).groupBy("s", "block", "whole", "rest").agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("place", _hash(F.lit(seed), "whole", "block")).withColumn("range", F.shiftright("place", 62 - int(math.log2(RANGES))))
    blocks = materialise(blocks, "mix-blocks")
    ranges = blocks.groupBy("s", "range", "rest").agg(F.sum("n").alias("n"))
    crossing_ranges = materialise(_crossing(ranges, ["s"], ["range"], "n", "rest"), "mix-ranges")
    crossed = crossing_ranges.select("s", F.col("cut.range").alias("range"), F.col("cut.left").alias("left"))
    inner = by_source(blocks.select("s", "place", "block", "n", F.col("range").alias("own")), crossed).filter("own = range")
    cut = _crossing(inner, ["s"], ["place", "block"], "n", "left").select("s", "cut.place", "cut.block", "cut.left")
    cut = materialise(cut, "mix-cuts")
    ended = by_source(by_source(counted, plan.select("s", "whole", "blocks", "rest")).filter("rest > 0"), cut).filter(F.pmod("r", "blocks") == F.col("block"))
    ended = ended.withColumn("at", _hash(F.lit(seed + 1), "whole", "r"))
    same = Window.partitionBy("s").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = ended.withColumn("before", F.sum("n").over(same) - F.col("n")).filter(F.col("before") < F.col("left")).groupBy("s").agg(F.max("at").alias("last_at"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("s", "of")
        return left.join(right.hint("merge"), left["s"].eqNullSafe(right["of"]), "left").drop("of")

    plan = beside(beside(plan, cut.select("s", F.col("place").alias("cut_place"), F.col("block").alias("cut_block"))), last)
    plan = materialise(plan, "mix-decisions")
    drop_table(blocks, crossing_ranges, cut, counted, totals)

    marked = packed(docs, s=named(source_col), r=row_hash, n=tokens)
    marked = by_source(marked, plan, P + "s").withColumn("block", F.pmod(P + "r", "blocks"))
    place, at = _hash(F.lit(seed), "whole", "block"), _hash(F.lit(seed + 1), "whole", P + "r")
    before = F.struct(place.alias("p"), F.col("block").alias("b")) < F.struct(F.col("cut_place").alias("p"), F.col("cut_block").alias("b"))
    partly = (F.col("rest") > 0) & (before | ((F.col("block") == F.col("cut_block")) & F.coalesce(at <= F.col("last_at"), F.lit(False))))
    passes = (F.col("whole") + F.when(partly, 1).otherwise(0)).cast("int")
    taken = marked.filter(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    epoch = F.col("epoch")
    size = F.greatest(F.lit(1e-9), F.col("budget") / F.greatest(F.lit(1), F.col("total")))
    # where the block stands in its pass; in the last, partial one, of the share that is taken
    spread = F.greatest(F.lit(1e-9), F.least(F.lit(1.0), size - epoch))
    share_taken = F.greatest(F.lit(1e-9), F.coalesce(F.col("cut_place"), F.lit(SPAN)) / F.lit(float(SPAN)))
    inside = (_hash(F.lit(seed), epoch.cast("long"), "block") / F.lit(float(SPAN))) * F.when(epoch < F.col("whole"), F.lit(1.0)).otherwise(spread / share_taken)
    new = {
        "n_tokens": F.col(P + "n"), "epoch": epoch, "block": F.col("block"), "order_key": F.round(F.least(F.lit(1.0), (epoch + F.least(F.lit(1.0), inside)) / size), 9),
        "doc_key": F.round(_hash(F.lit(seed + 1), epoch.cast("long"), P + "r") / F.lit(float(SPAN)), 9),
    }
    return taken.select(*unpacked(taken, keep), *[c.alias(free_name(name, keep)) for name, c in new.items()])
