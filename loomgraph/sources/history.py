"""Commit tables: scans of the newest commits, parents, checkpoints, files changed together, and fixed-string scans of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import materialize


def scan(commits: DataFrame, paths: DataFrame, newest: int = 256) -> DataFrame:
    """commit, made and path of the `newest` commits(commit, made) by time (ties: the larger commit). paths(commit, path)

    The bound is the operator's own: at most `newest` rows are kept by each task and sent on, and joined by broadcast."""
    last = commits.select("commit", "made").orderBy(F.desc("made"), F.desc("commit")).limit(newest)
    return paths.join(F.broadcast(last), "commit").select("commit", "made", "path").distinct()


def first_parents(commits: DataFrame) -> DataFrame:
    """commit and the one before it on its branch, null for the first. commits(commit, branch, made)"""
    return commits.select("commit", F.lag("commit").over(Window.partitionBy("branch").orderBy("made", "commit")).alias("parent"))


def by_checkpoint(commits: DataFrame, trailer: str = "Checkpoint") -> DataFrame:
    """checkpoint and the newest commit whose message has a line `<trailer>: <checkpoint>`. commits(commit, made, message)"""
    named = commits.withColumn("checkpoint", F.regexp_extract("message", rf"(?m)^{trailer}: (.+)$", 1)).filter("checkpoint <> ''")
    return named.groupBy("checkpoint").agg(F.max(F.struct("made", "commit")).alias("b")).select("checkpoint", F.col("b.commit").alias("commit"))


def cochanges(changes: DataFrame, most_files: int = 50, least: int = 2, top: int = 1000) -> DataFrame:
    """path_a, path_b, commits of files changed together at least `least` times, the `top` most frequent pairs (ties by path).

    Commits of more than `most_files` files say little and are skipped, which also bounds the pairs of one commit."""
    files = materialize(changes.select("commit", "path").distinct(), "history")
    small = files.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_files).select("commit")
    kept = files.join(small, "commit", "left_semi").groupBy("commit").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    first = kept.select("commit", "paths", F.posexplode("paths").alias("i", "path_a"))
    pairs = first.select("path_a", F.explode(F.slice("paths", F.col("i") + 2, F.greatest(F.size("paths") - F.col("i") - 1, F.lit(0)))).alias("path_b"))
    counted = pairs.groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("commits")).filter(F.col("commits") >= least)
    return counted.orderBy(F.desc("commits"), "path_a", "path_b").limit(top)


def grep(texts: DataFrame, patterns: list[str], text: str = "text", binary: bool = True) -> DataFrame:
    """A row of texts for each of the fixed patterns it holds, without regard to the case of letters A to Z; one pass, no join.

    Texts with a NUL character are skipped unless `binary`."""
    low = T.ascii_lower(F.coalesce(F.col(text), F.lit("")))
    asked = [_lower(p) for p in patterns]
    rows = texts if binary else texts.filter(~T.has_nul(F.coalesce(F.col(text), F.lit(""))))
    found = rows.withColumn("low", low).withColumn("pattern", F.explode(F.filter(F.array(*[F.lit(p) for p in asked]), lambda p: F.contains(F.col("low"), p))))
    return found.drop("low")


def _lower(pattern: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
