"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source_size copies. Expected copies are summed up along the source's
documents (ordered by size, so that every stretch of sizes gets its share), one random offset per source is added, and a
document is emitted once for every integer boundary that its stretch of the sum crosses. The word sums therefore follow
the targets closely, and a document gets only the two whole numbers around its expectation.

* Empty table: an empty result. Empty, null or blank texts have size 0; they take part and add no words.
* A source whose documents are all of size 0 has target 0 and gives no copies.
* Null source: its own source, ordered last. Null or repeated doc_id: each row counts; rows equal in doc_id, source and size are
  interchangeable.
* Further columns, whatever their names, are carried by `mix` and ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import free_name, materialize, rank_within

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0


def text_size(text):
    """Number of runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, weight, target): shares of `share` times all sizes by weight, each at most `limit` times its source.

    Resharing the excess by weight until none is above is the same as target = min(limit * size, level * weight) for one
    level. Only aggregates over sources reach the driver: each pass fixes the sources that the present level fills and
    recomputes the level from the rest, which ends after as many passes as the level has steps. Sources are numbered in
    code-point order in one task; that table has one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    per = materialize(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))), "sources")
    ratio = F.lit(float(limit)) * F.col("source_size") / F.col("weight")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, None
    while total:
        filled = F.lit(False) if level is None else ratio <= F.lit(level)
        held, open_weight = per.agg(
            F.coalesce(F.sum(F.when(filled, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0.0))
        ).first()
        if not open_weight:
            break
        now = (goal - limit * held) / open_weight
        if level is not None and now <= level:
            break
        level = now
    cap = F.lit(float(limit)) * F.col("source_size")
    return per.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if level is not None else F.lit(0.0))


def offset_of(source, seed: str):
    """The source's random offset in [0, 1): 32 bits of an MD5, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copy_counts(rows: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """rows(doc_id, source, size) with source_size, target and copies added.

    A document's place in its source's order is the number of smaller documents (from the histogram of sizes, bounded by
    the longest text) plus its salted rank among those of its size, so a source or a size with a third of all rows is
    spread over many tasks."""
    sources = source_targets(rows, weights, share, limit)
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    smaller = histogram.withColumn("smaller", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "size", "smaller")
    plan = smaller.join(sources, smaller["source"].eqNullSafe(sources["source"])).select(
        smaller["source"].alias("p_source"), F.col("size").alias("p_size"), "smaller", "source_size", "target"
    )
    salt = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 3)  # 4096 parts, as SQL can say too
    ranked = rank_within(rows, ["source", "size"], ["doc_id"], "place", salt)
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("smaller") + F.col("place")
    edge = lambda k: F.floor(rate * k + offset_of(F.col("source"), seed))
    return joined.withColumn("copies", (edge(at + 1) - edge(at)).cast("long")).drop("p_source", "p_size", "smaller", "place")


def mix_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: one row per document, texts not shuffled."""
    rows = materialize(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "mix-sizes")
    out = copy_counts(rows, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with each row repeated by its copies (0, 1 or 2), all columns kept.

    Copies are looked up by (doc_id, source, size); rows equal in all three are interchangeable and share their copies:
    the first ones in order get them. The text is shuffled once, by doc_id."""
    size, nth, copies = (free_name(docs, n) for n in ("mix_size", "mix_nth", "mix_copies"))
    key = [free_name(docs, n) for n in ("mix_id", "mix_source", "mix_of_size", "mix_place")]
    plan = mix_plan(docs, seed)
    mine = Window.partitionBy("doc_id", "source", "size").orderBy(F.col("copies").desc())
    plan = plan.withColumn("nth", F.row_number().over(mine)).filter(F.col("copies") > 0)
    plan = plan.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "size", "nth"), key)], F.col("copies").alias(copies))
    same = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    numbered = docs.withColumn(size, text_size(F.col("text"))).withColumn(nth, F.row_number().over(same))
    on = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (F.col(size) == F.col(key[2])) & (F.col(nth) == F.col(key[3]))
    taken = numbered.join(plan, on)
    again = free_name(docs, "mix_again")
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(c) for c in docs.columns])
