"""Semantic diff of two entity tables: pairing, change kinds, rename candidates, dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import unbroadcast

EXACT_SIZES = 16


def pair(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Full outer pairing on the key, the n-th occurrence of a key with the n-th. Entities have signature and body columns."""
    order = lambda *c: Window.partitionBy(*key).orderBy(*c)
    number = lambda df: df.withColumn("nth", F.row_number().over(order("signature", "body")))
    b, a = number(before).alias("b"), number(after).alias("a")
    on = [F.col(f"b.{k}") == F.col(f"a.{k}") for k in [*key, "nth"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = b.join(a, cond, "full_outer")
    keys = [F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key]
    change = (
        F.when(F.col("b.nth").isNull(), "added").when(F.col("a.nth").isNull(), "removed")
        .when(F.col("b.signature") != F.col("a.signature"), "signature_changed").when(F.col("b.body") != F.col("a.body"), "body_changed").otherwise("unchanged")
    )
    return joined.select(*keys, change.alias("change"), F.col("b.signature").alias("old_signature"), F.col("a.signature").alias("new_signature"))


def rename_candidates(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """Removed and added entities of one kind whose token sets are alike by Jaccard, the best added per removed (ties: smaller id).

    (id, kind, tokens array). Two sets of n and m tokens that are this alike share at least o = ceil(threshold (n + m) / (1 + threshold)),
    hence one of the first n - o + 1 and m - o + 1 of theirs, rarest first. So a set meets others by as many tokens as their size asks for,
    and a token that many have joins only sets whose sizes leave room for it. Sizes over EXACT_SIZES are taken in steps of a tenth."""
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), "kind", F.array_distinct("tokens").alias(f"{p}_tokens")).filter(F.size(f"{p}_tokens") > 0)
    r, a = side(removed, "old"), side(added, "new")
    tokens = lambda df, p: df.select("kind", f"{p}_id", F.size(f"{p}_tokens").alias("n"), F.explode(f"{p}_tokens").alias("token"))
    counts = tokens(r, "old").select("kind", "token").unionByName(tokens(a, "new").select("kind", "token")).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))

    def step(n):
        return F.when(n <= EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(F.log(n / EXACT_SIZES) / F.log(F.lit(1.1)))).cast("int")

    def first(df: DataFrame, p: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(f"{p}_id", "kind").orderBy("df", "token"))
        ranked = tokens(df, p).join(unbroadcast(counts), ["kind", "token"]).withColumn("nth", nth)
        others = F.explode(F.sequence(step(F.ceil(F.col("n") * threshold - 1e-9)), step(F.floor(F.col("n") / threshold + 1e-9)))).alias("other")
        ranked = ranked.select("kind", "token", f"{p}_id", "n", "nth", step(F.col("n")).alias("own"), others)
        least = F.greatest(F.ceil(F.col("n") * threshold - 1e-9), F.when(F.col("other") <= EXACT_SIZES, F.col("other")).otherwise(F.floor(EXACT_SIZES * F.pow(F.lit(1.1), F.col("other") - EXACT_SIZES)) - 1))
        share = F.ceil((F.col("n") + least) * threshold / (1 + threshold) - 1e-9)
        ranked = ranked.filter(F.col("nth") <= F.col("n") - share + 1)
        return ranked.select("kind", "token", f"{p}_id", *[F.col(c).alias(to) for c, to in zip(("own", "other"), ("old_step", "new_step") if p == "old" else ("new_step", "old_step"))])

    met = first(r, "old").join(unbroadcast(first(a, "new")), ["kind", "token", "old_step", "new_step"]).select("kind", "old_id", "new_id").distinct()
    both = F.size(F.array_intersect("old_tokens", "new_tokens"))
    scored = met.join(unbroadcast(r), ["kind", "old_id"]).join(unbroadcast(a), ["kind", "new_id"]).withColumn("exact", both / (F.size("old_tokens") + F.size("new_tokens") - both))
    scored = scored.withColumn("similarity", F.round("exact", 4)).filter(F.col("exact") >= threshold)
    best = Window.partitionBy("old_id").orderBy(F.desc("similarity"), "new_id")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").select("old_id", "new_id", "similarity")


def dependents(names: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct rows that mention each name as a whole token; names without mentions count 0."""
    mentions = docs.select(F.col(key), F.explode(F.array_distinct(T.terms(F.col(text)))).alias("name"))
    counted = mentions.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("name").distinct().join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("dependents"))
