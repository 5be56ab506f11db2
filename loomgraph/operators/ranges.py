"""Interval joins and regions of lines: enclosing spans, capped regions around hits, bridges between regions, focus lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def enclosing(points: DataFrame, spans: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """points(key, line) with the smallest of spans(key, start_line, end_line) that holds the line (ties: the first).

    Spans are repeated for each block of lines they touch, so the join is an equality on (key, block) with a residual; without this all
    spans of a key would meet all its points."""
    blocks = F.explode(F.sequence((F.col("start_line") / block).cast("int"), (F.col("end_line") / block).cast("int")))
    cut = spans.select(F.col(key).alias("s_key"), F.col("start_line"), F.col("end_line"), blocks.alias("s_block"))
    near = points.withColumn("p_block", (F.col("line") / block).cast("int"))
    met = near.join(cut, (F.col(key) == F.col("s_key")) & (F.col("p_block") == F.col("s_block")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "end_line")).alias("b")
    return met.groupBy(key, "line").agg(best).select(key, "line", F.col("b.start_line").alias("start_line"), F.col("b.end_line").alias("end_line"))


def overlapping(left: DataFrame, right: DataFrame, share: float = 0.6, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Pairs of regions(key, id, start_line, end_line) whose overlap is at least `share` of the shorter one, left.id < right.id."""
    cut = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), F.col("id").alias(p), F.col("start_line").alias(f"{p}_start"), F.col("end_line").alias(f"{p}_end"), F.explode(F.sequence((F.col("start_line") / block).cast("int"), (F.col("end_line") / block).cast("int"))).alias(f"{p}_block"))
    l, r = cut(left, "left"), cut(right, "right")
    met = l.join(r, (F.col("left_key") == F.col("right_key")) & (F.col("left_block") == F.col("right_block")) & (F.col("left") < F.col("right")))
    both = F.least("left_end", "right_end") - F.greatest("left_start", "right_start") + 1
    # a pair that shares several blocks is taken in the one where its overlap begins
    met = met.filter(F.col("left_block") == (F.greatest("left_start", "right_start") / block).cast("int"))
    shorter = F.least(F.col("left_end") - F.col("left_start"), F.col("right_end") - F.col("right_start")) + 1
    return met.withColumn("lines", both).filter((F.col("lines") > 0) & (F.col("lines") >= F.lit(share) * shorter)).select(F.col("left_key").alias(key), "left", "right", "lines")


def capped_regions(hits: DataFrame, context: int, most: int, key: str = "doc_id") -> DataFrame:
    """Regions around hits(key, line): a hit joins the region before it within 2 x context + 1 lines unless that would begin `most` lines earlier.

    The gap rule alone is a running sum; the span rule looks back to where the region began, so the lines of an island (a run without
    wider gaps) are folded in order, inside the JVM. A region is at most `most` lines long."""
    order = Window.partitionBy(key).orderBy("line")
    islands = hits.select(key, "line").distinct().withColumn("new", F.when(F.col("line") - F.lag("line").over(order) <= 2 * context + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    lines = islands.groupBy(key, "island").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    fold = lambda acc, x: F.when((F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1))["first"] < most), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), x.alias("last"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("first"), x.alias("last")))))
    folded = lines.select(key, F.explode(F.aggregate(F.col("lines").cast("array<int>"), empty, fold)).alias("r"))
    start = F.greatest(F.lit(1), F.col("r.first") - context)
    return folded.select(key, start.alias("start_line"), F.least(F.col("r.last") + context, start + most - 1).alias("end_line"))


def bridges(regions: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The stretch between a region and the next one of the same key where it is 1 to `most` lines long. regions(key, start_line, end_line)"""
    order = Window.partitionBy(key).orderBy("start_line", "end_line")
    after = regions.withColumn("next", F.lead("start_line").over(order))
    gap = F.col("next") - F.col("end_line") - 1
    return after.filter((gap >= 1) & (gap <= most)).select(key, (F.col("end_line") + 1).alias("start_line"), (F.col("next") - 1).alias("end_line"))


def focus_lines(lines: DataFrame, weight, context: int, key: str = "doc_id") -> DataFrame:
    """The line of most weight of each key (ties: the first; none where no line has any) and a window of `context` lines around it."""
    scored = lines.withColumn("weight", weight).filter("weight > 0")
    best = F.max(F.struct("weight", (-F.col("line")).alias("back"))).alias("b")
    last = lines.groupBy(key).agg(F.max("line").alias("last"))
    found = scored.groupBy(key).agg(best).join(last, key)
    line = -F.col("b.back")
    return found.select(key, line.alias("line"), F.col("b.weight").alias("weight"), F.greatest(F.lit(1), line - context).alias("start_line"), F.least(line + context, "last").alias("end_line"))
