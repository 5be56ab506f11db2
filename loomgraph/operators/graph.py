"""Operators on a typed property graph: nodes(id, kind, name, path, line) and edges(from_id, to_id, type, confidence, resolution, reason).

All are DataFrame expressions; each truncation has a total order and each ambiguity is an explicit count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, spread

RESOLUTION_TIERS = ["exact", "import_resolved", "type_inferred", "package", "import_external", "name_only", "pattern"]
DEGREE_TYPES = ("CALLS", "ASYNC_CALLS", "IMPLEMENTS", "OVERRIDES")


def union_nodes(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def matches_selector(column: str, selector: str) -> Column:
    """An exact id or a suffix after a colon."""
    return (F.col(column) == selector) | F.col(column).endswith(":" + selector)


def filter_edges(edges: DataFrame, source: str | None = None, target: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Edges by endpoint selectors and relation types; asking for CALLS also gives CONSTRUCTS."""
    out = edges
    if types:
        wanted = [*types, *(["CONSTRUCTS"] if "CALLS" in types else [])]
        out = out.filter(F.col("type").isin(wanted))
    if source:
        out = out.filter(matches_selector("from_id", source))
    return out.filter(matches_selector("to_id", target)) if target else out


def resolution_tier(column: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RESOLUTION_TIERS]), column), F.lit(0)).cast("int")


def endpoint_tier(kind: Column) -> Column:
    return F.when(kind == "file", 1).when(kind.startswith("external"), 2).otherwise(0)


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge once per endpoint: focus, direction, other end with its node columns."""
    both = edges.select(F.col("from_id").alias("focus"), F.lit("outgoing").alias("direction"), F.col("to_id").alias("id"), "type", "confidence", "resolution").unionByName(
        edges.select(F.col("to_id").alias("focus"), F.lit("incoming").alias("direction"), F.col("from_id").alias("id"), "type", "confidence", "resolution")
    )
    return both.join(nodes.select("id", "kind", "name", "path", "line"), "id")


def neighbors(edges: DataFrame, nodes: DataFrame, foci: DataFrame, limit: int) -> DataFrame:
    """The `limit` best edges per focus and direction, with totals and a truncation flag.

    The order is endpoint tier, resolution tier, confidence (falling), path, line, name, id, type, resolution. Edges are derived once and
    written, as are those of the foci with their other ends. The window keeps only the best rows of each task before the
    shuffle; totals come from a partial aggregation, so a hub never gathers in one place."""
    near = incident(materialize(edges, "edges"), nodes).join(foci.select(F.col("id").alias("focus")).distinct(), "focus", "left_semi")
    near = materialize(near, "near")
    order = [endpoint_tier(F.col("kind")), resolution_tier(F.col("resolution")), F.col("confidence").desc(), "path", "line", "name", "id", "type", "resolution"]
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("focus", "direction").orderBy(*order))).filter(F.col("rank") <= limit)
    totals = near.groupBy("focus", "direction").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, ["focus", "direction"]).withColumn("truncated", F.col("total") > limit)


def paths_through(edges: DataFrame, foci: DataFrame, limit: int) -> DataFrame:
    """Caller, focus, callee triples, at most `limit` per focus by (caller, callee); either side is cut to `limit` first, so a hub
    yields at most limit x limit intermediate rows."""
    edges = materialize(edges.select("from_id", "to_id"), "edges")
    order_in = Window.partitionBy("to_id").orderBy("from_id")
    order_out = Window.partitionBy("from_id").orderBy("to_id")
    callers = edges.join(foci.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id").distinct()
    callees = edges.join(foci.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id").distinct()
    callers = callers.withColumn("n", F.row_number().over(order_in)).filter(F.col("n") <= limit).select(F.col("from_id").alias("caller"), F.col("to_id").alias("focus"))
    callees = callees.withColumn("n", F.row_number().over(order_out)).filter(F.col("n") <= limit).select(F.col("from_id").alias("focus"), F.col("to_id").alias("callee"))
    both = callers.join(callees, "focus")
    order = Window.partitionBy("focus").orderBy("caller", "callee")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def focus_matches(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Per asked name, case-insensitively: matches, the first by (path, line, id), and whether the name is ambiguous."""
    lower = nodes.groupBy(F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("matches"), F.min(F.struct("path", "line", "id")).alias("first"))
    return names.select(F.lower("name").alias("key")).distinct().join(lower, "key").select("key", "matches", F.col("first.id").alias("first_id"), (F.col("matches") > 1).alias("ambiguous"))


def inbound_degree(edges: DataFrame, types=DEGREE_TYPES) -> DataFrame:
    return edges.filter(F.col("type").isin(list(types))).groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def centrality(degree: Column) -> Column:
    return F.round(F.least(F.lit(6.0), 1.6 * F.log1p(degree.cast("double"))), 4)


def cochange(commits: DataFrame, max_files: int = 50, at_least: int = 2, top: int = 1000) -> DataFrame:
    """Pairs of paths changed together in at least `at_least` commits; commits of more than max_files paths don't count,
    which bounds the pairs of a commit. commits(commit, path)."""
    each = spread(commits, "commit").distinct()
    small = each.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, max_files)).select("commit")
    kept = each.join(small, "commit").groupBy("commit").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    pairs = kept.select(F.posexplode("paths").alias("i", "left"), "paths").select("left", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= at_least).orderBy(F.desc("count"), "left", "right").limit(top)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "exact").when(confidence >= 0.70, "strong").when(confidence >= 0.40, "heuristic").otherwise("weak")


def completeness_level(files: Column, parsed: Column, symbols: Column, failures: Column) -> Column:
    return F.when(files == 0, "ok").when((parsed * 2 < files) | (failures * 4 >= files), "unsafe").when((failures > 0) | (symbols == 0), "degraded").otherwise("ok")


def dedup_relations(edges: DataFrame) -> DataFrame:
    """One edge per (from_id, to_id, type): the most confident, then the best resolution tier."""
    best = F.min_by(F.struct("confidence", "resolution"), F.struct((-F.col("confidence")).alias("c"), resolution_tier(F.col("resolution")).alias("t"), F.col("resolution").alias("r")))
    return edges.groupBy("from_id", "to_id", "type").agg(best.alias("b")).select("from_id", "to_id", "type", "b.confidence", "b.resolution")


def merge_externals(externals: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One record per key, each field the first non-null one by `order`."""
    picks = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return externals.groupBy(key).agg(*picks, F.count(F.lit(1)).alias("records"))


def expand(seeds: DataFrame, edges: DataFrame, types: list[str], factor: float = 0.28, min_confidence: float = 0.7, top: int = 20) -> DataFrame:
    """Neighbours of seeds(id, score) in both directions over confident edges, scored by factor x seed, the best per id, the top ones."""
    usable = edges.filter(F.col("type").isin(types) & (F.col("confidence") >= min_confidence))
    both = usable.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(usable.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    scored = both.join(seeds, "id").groupBy(F.col("other").alias("id")).agg(F.round(F.max(F.col("score") * factor), 4).alias("score"))
    return scored.join(seeds.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(top)


def resolve_ladder(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """The first tier that matches a call: same scope .92, same group .80, globally unique name .68; a name that is
    ambiguous in its tier gives no edge. calls(call_id, name, scope, grp), definitions(id, name, scope, grp).

    Counts per (name, scope), (name, grp) and (name) are aggregated before the joins, so no candidate list is multiplied out."""
    tiers = [(1, ["name", "scope"], 0.92, "exact"), (2, ["name", "grp"], 0.80, "package"), (3, ["name"], 0.68, "name_only")]
    out = calls
    for tier, keys, _, _ in tiers:
        counted = definitions.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{tier}"), F.min("id").alias(f"id{tier}"))
        out = out.join(counted, keys, "left")
    first = F.when(F.col("n1").isNotNull(), 1).when(F.col("n2").isNotNull(), 2).when(F.col("n3").isNotNull(), 3)
    out = out.withColumn("tier", first)
    pick = lambda name: reduce(lambda c, t: c.when(F.col("tier") == t[0], F.col(f"{name}{t[0]}")), tiers, F.when(F.lit(False), F.col(f"{name}1")))
    out = out.withColumns({"to_id": pick("id"), "candidates": pick("n")}).filter("candidates = 1")
    conf = reduce(lambda c, t: c.when(F.col("tier") == t[0], F.lit(t[2])), tiers, F.when(F.lit(False), F.lit(0.0)))
    res = reduce(lambda c, t: c.when(F.col("tier") == t[0], F.lit(t[3])), tiers, F.when(F.lit(False), F.lit("")))
    return out.select("call_id", "to_id", conf.alias("confidence"), res.alias("resolution"))
