"""Excerpts of hits: current, stale or missing lines, and where in a long chunk to look.

All of it is expressions: line tables, sliding frames over a chunk's lines, joins on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import fixed
from lakeseek.functions.text import is_definition, line_slice, split_lines, terms


def snippets(hits: DataFrame, indexed: DataFrame, current: DataFrame) -> DataFrame:
    """``hits`` (doc_id, start_line, end_line, ...) with snippet (text, status).

    indexed (doc_id, content_hash), current (doc_id, text): missing without a current text, stale if its hash differs (no text then), else ok.
    """
    now = current.select("doc_id", F.col("text").alias("__text"), F.sha2("text", 256).alias("__hash"))
    both = hits.join(indexed.select("doc_id", F.col("content_hash").alias("__indexed")), "doc_id", "left").join(now, "doc_id", "left")
    status = F.when(F.col("__text").isNull(), "missing").when(~F.col("__hash").eqNullSafe(F.col("__indexed")), "stale").otherwise("ok")
    text = F.when(status == "ok", line_slice(split_lines(F.col("__text")), F.col("start_line"), F.col("end_line")))
    return both.withColumn("snippet", F.struct(text.alias("text"), status.alias("status"))).drop("__text", "__hash", "__indexed")


def lines_table(chunks: DataFrame, *keys: str, empty_line: bool = False) -> DataFrame:
    """(*keys, i, line): a row for each line of ``text``, from 0; of an empty text none, or with ``empty_line`` an empty one."""
    return chunks.select(*keys, F.posexplode(split_lines(F.col("text"), empty_line)).alias("i", "line"))


def _asked_lines(chunks: DataFrame, query: str, *keys: str) -> DataFrame:
    """(*keys, __asked, i, line): lines with the query's terms, which are taken once per chunk."""
    return lines_table(chunks.select(*keys, "text", terms(F.col(query)).alias("__asked")), *keys, "__asked")


def matching_lines(chunks: DataFrame, query: str, *keys: str) -> DataFrame:
    """(*keys, i): lines that share a term with the query column."""
    return _asked_lines(chunks, query, *keys).filter(F.arrays_overlap(terms(F.col("line")), F.col("__asked"))).select(*keys, "i")


def focus(chunks: DataFrame, query: str, *keys: str, budget: int = fixed.SNIPPET_LINES) -> DataFrame:
    """(*keys, focus) of every chunk: ``focus_and_matches`` with 0 for chunks of no line."""
    found = focus_and_matches(chunks, query, *keys, budget=budget).drop("match")
    return chunks.select(*keys).join(found, list(keys), "left").withColumn("focus", F.coalesce("focus", F.lit(0)))


def focus_and_matches(chunks: DataFrame, query: str, *keys: str, budget: int = fixed.SNIPPET_LINES) -> DataFrame:
    """(*keys, focus, match) of chunks with lines: the line, from 0, at which to start showing ``budget`` lines of ``text``, and the lines with a term of the query.

    A line scores the rarity (one over the number of lines) of the query's terms in it, twice that on a definition line. The earliest best
    window wins, unless the first one is as good; it starts at its first scoring line, or the definition up to six lines above that, with
    the decorators over it, and never so late that lines are left over.

    The texts are dealt by their keys once; every frame and aggregate below keeps to that, so lines are never shuffled.
    """
    lines = _asked_lines(chunks.repartition(*keys), query, *keys)
    found = F.array_intersect(terms(F.col("line")), F.col("__asked"))
    each = lines.select(*keys, "i", is_definition(F.col("line")).alias("definition"), F.ltrim("line").startswith("@").alias("decorator"), F.explode_outer(found).alias("term"))
    rarity = F.when(F.col("term").isNotNull(), 1 / F.count("*").over(Window.partitionBy(*keys, "term")))
    every = each.withColumn("weight", rarity).groupBy(*keys, "i").agg(F.max("definition").alias("definition"), F.max("decorator").alias("decorator"), F.sum("weight").alias("raw"))
    every = every.withColumn("s", F.coalesce(F.col("raw") * F.when(F.col("definition"), 2).otherwise(1), F.lit(0.0)))
    order = Window.partitionBy(*keys).orderBy("i")
    above = order.rowsBetween(-fixed.LOOK_BACK, 0)
    not_decorator = F.last(F.when(~F.col("decorator"), F.col("i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    framed = every.withColumns({
        "n": F.count("*").over(Window.partitionBy(*keys)), "window": F.round(F.sum("s").over(order.rowsBetween(0, budget - 1)), 9),
        "first": F.first(F.when(F.col("s") > 0, F.col("i")), ignorenulls=True).over(order.rowsBetween(0, budget - 1)),
        "definition_above": F.last(F.when(F.col("definition"), F.col("i")), ignorenulls=True).over(above),
        "run_start": F.coalesce(not_decorator, F.lit(-1)) + 1,
    })
    fits = F.col("i") <= F.greatest(F.lit(0), F.col("n") - budget)
    best = framed.groupBy(*keys).agg(
        F.max(F.when(fits, F.struct("window", (-F.col("i")).alias("back"), "first", "n"))).alias("b"),
        F.array_sort(F.collect_list(F.struct("i", "definition_above", "run_start", F.col("raw").isNotNull().alias("found")))).alias("at"),  # of one text's lines
    )
    hit, n = F.col("b.first"), F.col("b.n")
    best = best.withColumn("start", F.coalesce(F.try_element_at("at", hit + 1)["definition_above"], hit))
    value = F.when((n <= budget) | (F.col("b.window") <= 0) | F.col("start").isNull(), F.lit(0)).otherwise(F.least(F.try_element_at("at", F.col("start") + 1)["run_start"], n - budget))
    match = F.transform(F.filter("at", lambda x: x["found"]), lambda x: x["i"])
    return best.select(*keys, value.cast("int").alias("focus"), match.alias("match"))
