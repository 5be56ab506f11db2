"""The registered queries of the engine's own operators over the driver's tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import diff, graph, search, similarity
from loomgraph.session import materialize, unbroadcast
from loomgraph.sources import code, tables
from loomgraph.streaming import sessions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, 'region/' || r_name AS path, CAST(r_regionkey AS BIGINT) AS line FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation/' || n_name, n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer/' || c_name, c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier/' || s_name, s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'part/' || p_name, p_partkey FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'orders', o_orderpriority, 'orders/' || o_orderpriority, o_orderkey FROM orders)"""
DEFINES = """defines AS (
  SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'DEFINES' AS type, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS resolution FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'DEFINES', 1.0, 'exact' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'DEFINES', 1.0, 'exact' FROM supplier)"""
EDGES = """edges AS (
  SELECT 'customer:' || o_custkey AS from_id, 'orders:' || o_orderkey AS to_id, 'PLACED' AS type,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence, 'exact' AS resolution FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', max(1 - l_discount),
    CASE min(l_returnflag) WHEN 'A' THEN 'exact' WHEN 'N' THEN 'import_resolved' ELSE 'name_only' END FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', max(1 - l_discount),
    CASE min(l_returnflag) WHEN 'A' THEN 'exact' WHEN 'N' THEN 'import_resolved' ELSE 'name_only' END FROM lineitem GROUP BY l_partkey, l_suppkey)"""
TIER = "CASE resolution WHEN 'exact' THEN 1 WHEN 'import_resolved' THEN 2 WHEN 'type_inferred' THEN 3 WHEN 'package' THEN 4 WHEN 'import_external' THEN 5 WHEN 'name_only' THEN 6 WHEN 'pattern' THEN 7 ELSE 0 END"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = f"regexp_extract_all({LOW}, '[a-z0-9]+')"
NEAR = f"""{NODES}, {EDGES}, inc AS (
  SELECT from_id AS focus, 'outgoing' AS direction, to_id AS id, type, confidence, resolution FROM edges
  UNION ALL SELECT to_id, 'incoming', from_id, type, confidence, resolution FROM edges),
near AS (SELECT focus, direction, i.id, kind, name, path, line, type, confidence, resolution FROM inc i JOIN nodes n ON i.id = n.id WHERE focus LIKE 'supplier:%' OR focus LIKE 'customer:%'),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY focus, direction ORDER BY {TIER}, confidence DESC, path, line, name, id, type, resolution) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY focus, direction) AS total FROM near)"""


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _foci(spark, d):
    return tables.nodes(spark, d).filter(F.col("kind").isin("supplier", "customer"))


# graph -----------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT id, kind, name, path, line FROM nodes")
def graph_nodes_union(spark, d):
    return tables.nodes(spark, d)


@query(f"WITH {DEFINES} SELECT * FROM defines")
def graph_defines(spark, d):
    return tables.defines(spark, d)


@query(f"WITH {EDGES} SELECT from_id, to_id, type, confidence, resolution FROM edges WHERE type = 'CONTAINS'")
def graph_contains(spark, d):
    return graph.filter_edges(tables.edges(spark, d), types=["CONTAINS"])


@query(f"WITH {EDGES} SELECT * FROM edges WHERE to_id = '7' OR to_id LIKE '%:7'")
def edges_filter_to(spark, d):
    return graph.filter_edges(tables.edges(spark, d), target="7")


@query(f"WITH {EDGES} SELECT * FROM edges WHERE (from_id = 'part:7' OR from_id LIKE '%:part:7') AND type = 'SUPPLIED_BY'")
def edges_filter_from_relation(spark, d):
    return graph.filter_edges(tables.edges(spark, d), source="part:7", types=["SUPPLIED_BY"])


@query(f"WITH {NEAR} SELECT focus, direction, rank, id, name, type, confidence, resolution, total, total > 20 AS truncated FROM ranked WHERE rank <= 20")
def neighbors_topk(spark, d):
    """The 20 best edges in each direction of every supplier and customer."""
    found = graph.neighbors(tables.edges(spark, d), tables.nodes(spark, d), _foci(spark, d), 20)
    return found.select("focus", "direction", "rank", "id", "name", "type", "confidence", "resolution", "total", "truncated")


@query(f"WITH {NEAR} SELECT focus, direction, count(*) AS total, least(count(*), 20) AS kept, count(*) > 20 AS truncated FROM near GROUP BY focus, direction")
def neighbors_totals_truncated(spark, d):
    near = graph.incident(tables.edges(spark, d), tables.nodes(spark, d)).join(_foci(spark, d).select(F.col("id").alias("focus")), "focus", "left_semi")
    n = F.count(F.lit(1))
    return near.groupBy("focus", "direction").agg(n.alias("total"), F.least(n, F.lit(20)).alias("kept"), (n > 20).alias("truncated"))


@query(f"WITH {EDGES}, c AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM edges WHERE to_id LIKE 'part:%'), e AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS n FROM edges WHERE from_id LIKE 'part:%'), p AS (SELECT c.from_id AS caller, c.to_id AS focus, e.to_id AS callee, CAST(row_number() OVER (PARTITION BY c.to_id ORDER BY c.from_id, e.to_id) AS INTEGER) AS rank FROM c JOIN e ON c.to_id = e.from_id AND c.n <= 10 AND e.n <= 10) SELECT * FROM p WHERE rank <= 10")
def neighbors_paths_2hop(spark, d):
    return graph.paths_through(tables.edges(spark, d), tables.nodes(spark, d).filter("kind = 'part'"), 10).select("caller", "focus", "callee", "rank")


@query(f"WITH {NODES}, {EDGES} SELECT from_id, to_id, type FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE kind <> 'customer') AND to_id IN (SELECT id FROM nodes WHERE kind <> 'customer')")
def neighbors_internal_only(spark, d):
    """Edges both of whose ends are known nodes that are not of the excluded class."""
    inner = tables.nodes(spark, d).filter("kind <> 'customer'").select("id")
    e = tables.edges(spark, d).join(inner.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return e.join(inner.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "type")


@query(f"WITH {NODES}, p AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path, line, id) AS n, count(*) OVER (PARTITION BY lower(name)) AS matches FROM nodes) SELECT lower(name) AS key, matches, id AS first_id, matches > 1 AS ambiguous FROM p WHERE n = 1")
def neighbors_ambiguous_focus(spark, d):
    n = tables.nodes(spark, d)
    return graph.focus_matches(n, n.select("name"))


@query(f"WITH {EDGES} SELECT to_id AS id, count(*) AS degree FROM edges WHERE type IN ('CONTAINS', 'SUPPLIED_BY') GROUP BY to_id")
def inbound_degree(spark, d):
    return graph.inbound_degree(tables.edges(spark, d), ("CONTAINS", "SUPPLIED_BY"))


@query(f"WITH {EDGES} SELECT to_id AS id, round(least(6.0, 1.6 * ln(1 + CAST(count(*) AS DOUBLE))), 4) AS centrality FROM edges WHERE type IN ('CONTAINS', 'SUPPLIED_BY') GROUP BY to_id")
def centrality_score(spark, d):
    return inbound_degree(spark, d).select("id", graph.centrality(F.col("degree")).alias("centrality"))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem), s AS (SELECT c FROM e GROUP BY c HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT e.* FROM e JOIN s USING (c)) SELECT a.p AS \"left\", b.p AS \"right\", count(*) AS count FROM k a JOIN k b ON a.c = b.c AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2 ORDER BY count(*) DESC, a.p, b.p LIMIT 1000")
def cochange_pairs(spark, d):
    """Parts ordered together, as files changed together: the 1000 strongest pairs."""
    return graph.cochange(tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")))


@query(f"WITH {EDGES} SELECT type, resolution, count(*) AS n FROM edges GROUP BY type, resolution")
def relation_histogram(spark, d):
    return tables.edges(spark, d).groupBy("type", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT type, CASE WHEN confidence >= 0.9 THEN 'exact' WHEN confidence >= 0.7 THEN 'strong' WHEN confidence >= 0.4 THEN 'heuristic' ELSE 'weak' END AS band, count(*) AS n FROM edges GROUP BY 1, 2")
def confidence_bands(spark, d):
    return tables.edges(spark, d).groupBy("type", graph.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def completeness_by_language(spark, d):
    return tables.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("WITH c AS (SELECT lang, count(*) AS files, count(quality) AS parsed, count(*) FILTER (WHERE quality = 1) AS symbols, count(*) FILTER (WHERE toxic = 1) AS failures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, files, parsed, symbols, failures, CASE WHEN files = 0 THEN 'ok' WHEN parsed * 2 < files OR failures * 4 >= files THEN 'unsafe' WHEN failures > 0 OR symbols = 0 THEN 'degraded' ELSE 'ok' END AS level FROM c")
def completeness_level(spark, d):
    """Per language: labelled documents as parsed files, good ones as symbols, toxic ones as failures."""
    joined = tables.table(spark, d, "documents").select("doc_id", "lang").join(tables.table(spark, d, "labels"), "doc_id", "left")
    counts = joined.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count("quality").alias("parsed"), F.count_if(F.col("quality") == 1).alias("symbols"), F.count_if(F.col("toxic") == 1).alias("failures"))
    return counts.withColumn("level", graph.completeness_level(F.col("files"), F.col("parsed"), F.col("symbols"), F.col("failures")))


@query(f"WITH raw AS (SELECT 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id, 'SUPPLIED_BY' AS type, 1 - l_discount AS confidence, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'import_resolved' ELSE 'name_only' END AS resolution FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY confidence DESC, {TIER}) AS n FROM raw) SELECT from_id, to_id, type, confidence, resolution FROM r WHERE n = 1")
def relation_dedup(spark, d):
    l = tables.table(spark, d, "lineitem")
    raw = l.select(tables._id("part", "l_partkey").alias("from_id"), tables._id("supplier", "l_suppkey").alias("to_id"), F.lit("SUPPLIED_BY").alias("type"), (1 - F.col("l_discount")).alias("confidence"), tables._resolution(F.col("l_returnflag")).alias("resolution"))
    return graph.dedup_relations(raw)


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"SELECT {_HOST} AS host, arg_min(url, page_id) FILTER (WHERE url IS NOT NULL) AS url, arg_min(length(html), page_id) FILTER (WHERE html IS NOT NULL) AS html_chars, count(*) AS records FROM pages GROUP BY 1")
def external_merge(spark, d):
    pages = tables.table(spark, d, "pages").select(F.expr(_HOST).alias("host"), "page_id", "url", F.length("html").cast("long").alias("html_chars"))
    return graph.merge_externals(pages, "host", "page_id", ["url", "html_chars"])


@query("SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)")
def benchmark_aggregate(spark, d):
    return tables.table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


# scans -----------------------------------------------------------------------------------------


@query("SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > 0 AND list_sum(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN strlen(x) > 2000 THEN strlen(x) ELSE 0 END)) >= 0.7 * strlen(text)")
def minified_filter(spark, d):
    t = F.col("text")
    return tables.table(spark, d, "documents").filter(T.minified(t, 2000)).select("doc_id", F.octet_length(t).cast("long").alias("bytes"))


@query("SELECT doc_id, strlen(text) AS bytes, CASE WHEN strlen(text) > 8192 THEN 'E_FILE_TOO_LARGE' END AS failure FROM documents")
def oversize_filter(spark, d):
    n = F.octet_length("text")
    return tables.table(spark, d, "documents").select("doc_id", n.cast("long").alias("bytes"), F.when(n > 8192, "E_FILE_TOO_LARGE").alias("failure"))


@query("SELECT page_id FROM pages WHERE position(chr(0) IN html) = 0")
def binary_filter(spark, d):
    return tables.table(spark, d, "pages").filter(~T.has_nul(F.col("html"))).select("page_id")


@query("SELECT page_id, CASE regexp_extract(url, '[.]([a-z0-9]+)([?#]|$)', 1) WHEN 'html' THEN 'HTML' WHEN 'php' THEN 'PHP' WHEN 'js' THEN 'JavaScript' ELSE 'unknown' END AS language FROM pages")
def language_detect_ext(spark, d):
    ext = F.regexp_extract("url", "[.]([a-z0-9]+)([?#]|$)", 1)
    return tables.table(spark, d, "pages").select(
        "page_id", F.when(ext == "html", "HTML").when(ext == "php", "PHP").when(ext == "js", "JavaScript").otherwise("unknown").alias("language")
    )


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages), r(n, pat, ign) AS (VALUES (1, '.*', TRUE), (2, '^(en|de)/.*', FALSE), (3, '.*[.]html$', TRUE), (4, '^en/1.*', FALSE)), m AS (SELECT page_id, path, arg_max(ign, n) AS ignored FROM p JOIN r ON regexp_matches(path, pat) GROUP BY page_id, path) SELECT * FROM m")
def ignore_rules(spark, d):
    pages = tables.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))
    rules = [(".*", True), ("^(en|de)/.*", False), (".*[.]html$", True), ("^en/1.*", False)]
    return pages.withColumn("ignored", code.ignored(F.col("path"), rules))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])>', 1)) AS level, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) AS title FROM pages")
def page_sections(spark, d):
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit("<h([1-6])>"), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1)).alias("title"))
    return tables.table(spark, d, "pages").select("page_id", F.explode(both).alias("s")).select("page_id", "s.level", "s.title")


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def page_links(spark, d):
    links = tables.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


_HASH = "substr(sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'))), 1, 16)"


@query(f"SELECT doc_id, {_HASH} AS body_hash FROM documents")
def body_hash_fingerprint(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", T.body_hash(F.col("text")).alias("body_hash"))


# search ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY doc_id, term")
def term_counts(spark, d):
    return search.term_counts(tables.table(spark, d, "documents"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term")
def document_frequency(spark, d):
    return search.document_frequency(tables.table(spark, d, "documents"))


_BM = f"""WITH q AS (SELECT DISTINCT item_id AS query, unnest({TERMS}) AS term FROM benchmark), t AS (SELECT doc_id, {TERMS} AS ts FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(greatest(1, len(ts))) AS average FROM t), p AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM t),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT query, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 4) AS score, count(*) AS matched
FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY query, doc_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)"""


def _bm25(spark, d):
    q = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return search.bm25_top(tables.table(spark, d, "documents"), q, 20)


@query(_BM + " SELECT query, doc_id, score, matched, rank FROM top WHERE rank <= 20")
def bm25_documents(spark, d):
    """The 20 best documents for every benchmark passage."""
    return _bm25(spark, d)


@query(f"WITH {NODES} SELECT id, CAST(CASE WHEN path LIKE 'src/%' OR path LIKE '%/src/%' THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '(^|/)(tests?|spec)(/|$)') THEN -12 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '(^|/)docs?(/|$)') THEN -6 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '(^|/)(vendor|third_party|node_modules)(/|$)') THEN -5 ELSE 0 END AS DOUBLE) AS prior FROM nodes")
def path_prior_score(spark, d):
    return tables.nodes(spark, d).select("id", T.path_prior(F.col("path")).alias("prior"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = 'part' THEN 14 ELSE 0 END + CASE WHEN lower(p_name) = 'part' THEN 6 WHEN contains(lower(p_name), 'part') THEN 3 ELSE 0 END AS DOUBLE) AS score FROM part")
def symbol_name_score(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.name_score(F.col("p_name"), "part").alias("score"))


@query("WITH n AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), h AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 8) / 6) AS BIGINT)))) AS h FROM n) SELECT doc_id, CAST(h * 6 + 1 AS INTEGER) AS start_line, CAST(least(h * 6 + 8, n) AS INTEGER) AS end_line FROM h")
def line_windows(spark, d):
    return search.line_windows(tables.table(spark, d, "documents"), 8, 6)


_HITS = "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), h AS (SELECT doc_id, line FROM l WHERE contains(t, 'the')), m AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= 3 THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS region FROM m)"


@query(_HITS + " SELECT doc_id, CAST(region AS BIGINT) AS region, CAST(greatest(1, min(line) - 1) AS INTEGER) AS start_line, CAST(max(line) + 1 AS INTEGER) AS end_line, count(*) AS hits FROM g GROUP BY doc_id, region")
def hit_regions(spark, d):
    hits = search.lines_of(tables.table(spark, d, "documents")).filter(F.contains("line_text", F.lit("the"))).select("doc_id", "line")
    return search.hit_regions(hits, 1)


@query(_BM + ", a AS (SELECT doc_id, CAST(max(n_chars) AS BIGINT) AS n FROM documents GROUP BY doc_id), l AS (SELECT query, doc_id, rank AS lr, row_number() OVER (PARTITION BY query ORDER BY matched DESC, doc_id) AS rr FROM top WHERE rank <= 20) SELECT query, doc_id, round(1.0 / (60 + lr) + 2.0 / (60 + rr), 8) AS score FROM l")
def rrf_fusion(spark, d):
    """Fuses the ranking by score with the ranking by matched terms, per query."""
    top = materialize(_bm25(spark, d), "top").withColumn("key", F.struct("query", "doc_id"))
    right = top.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("matched"), "doc_id")))
    return search.rrf(top.select("key", "rank"), right.select("key", "rank"), "key").select("key.query", "key.doc_id", "score")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def sibling_lag_lead(spark, d):
    return search.siblings(tables.table(spark, d, "conversations"), "conv_id", "turn", "role")


@query(f"WITH {EDGES}, seeds AS (SELECT 'supplier:' || s_suppkey AS id, s_acctbal AS score FROM supplier WHERE s_acctbal > 9000), u AS (SELECT * FROM edges WHERE type IN ('SUPPLIED_BY', 'CONTAINS') AND confidence >= 0.7), b AS (SELECT from_id AS id, to_id AS other FROM u UNION ALL SELECT to_id, from_id FROM u), s AS (SELECT other AS id, round(max(score * 0.28), 4) AS score FROM b JOIN seeds USING (id) GROUP BY other) SELECT * FROM s WHERE id NOT IN (SELECT id FROM seeds) ORDER BY score DESC, id LIMIT 20")
def graph_expansion(spark, d):
    """The 20 best neighbours of the wealthiest suppliers."""
    seeds = tables.table(spark, d, "supplier").filter("s_acctbal > 9000").select(tables._id("supplier", "s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return graph.expand(seeds, tables.edges(spark, d), ["SUPPLIED_BY", "CONTAINS"])


@query(f"WITH s AS (SELECT DISTINCT unnest({TERMS}) AS term FROM benchmark), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), u AS (SELECT DISTINCT doc_id, line, unnest({TERMS}) AS term FROM l), r AS (SELECT term, doc_id, CAST(line AS INTEGER) AS line, row_number() OVER (PARTITION BY term ORDER BY doc_id, line) AS n FROM u WHERE term IN (SELECT term FROM s)) SELECT term, doc_id, line FROM r WHERE n <= 3")
def identifier_usage(spark, d):
    """The first three lines that use each benchmark term as a whole token."""
    seeds = tables.table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    lines = search.lines_of(tables.table(spark, d, "documents")).select("doc_id", "line", F.explode(F.array_distinct(T.terms(F.col("line_text")))).alias("term"))
    used = lines.join(seeds, "term", "left_semi")
    return used.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id", "line"))).filter("n <= 3").select("term", "doc_id", "line")


@query(f"SELECT {_HASH} AS fingerprint, min(doc_id) AS doc_id, count(*) AS mirrors FROM documents GROUP BY 1")
def mirror_dedup(spark, d):
    return search.mirrors(tables.table(spark, d, "documents"), T.body_hash(F.col("text")), "doc_id")


@query("WITH r AS (SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) SELECT * FROM r WHERE used <= 20000")
def budget_fit(spark, d):
    """Per source, the shortest documents that fit 20,000 characters together."""
    return search.within_budget(tables.table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"], "n_chars", 20000)


@query()
def search_hybrid(spark, d):
    """Ten diverse results from the best-ranked documents of all benchmark passages together; the greedy step runs on 200 rows."""
    best = _bm25(spark, d).groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)
    rows = [{"path": f"doc/{r.doc_id}", "start": 1, "end": 1, "score": r.score, "symbol": None} for r in best.collect()]
    picked = search.diverse(rows, 10, per_file=1)
    return spark.createDataFrame([(i + 1, p["path"], p["score"]) for i, p in enumerate(picked)], "rank int, path string, score double")


_GRAMS = f"""WITH t AS (SELECT doc_id, {TERMS} AS t FROM documents), g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS g FROM t WHERE len(t) >= 3),
k AS (SELECT doc_id, g FROM g WHERE len(g) >= 8)"""


@query(_GRAMS + ", s AS (SELECT g, min(doc_id) AS rep FROM k GROUP BY g), e AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM s), p AS (SELECT a.rep AS l, b.rep AS r, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared FROM e a JOIN e b ON a.gram = b.gram AND a.rep < b.rep GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", round(shared / (an + bn - shared), 4) AS jaccard FROM p WHERE shared / (an + bn - shared) >= 0.82")
def shingle_jaccard_pairs(spark, d):
    return similarity.exact_pairs(tables.table(spark, d, "documents"))


@query(_GRAMS + ", c AS (SELECT g, min(doc_id) AS representative FROM k GROUP BY g) SELECT k.doc_id AS id, representative FROM k JOIN c ON k.g = c.g")
def clone_classes(spark, d):
    return similarity.clone_classes(tables.table(spark, d, "documents"))


@query()
def minhash_lsh_pairs(spark, d):
    return similarity.clone_pairs(tables.table(spark, d, "documents"))


# diff ------------------------------------------------------------------------------------------


def _versions(spark, d):
    p = tables.table(spark, d, "part")
    entity = lambda df: df.select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("signature"), (F.col("p_size").cast("string")).alias("body"))
    after = p.filter("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    after = after.withColumn("p_name", F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit(" renamed"))).otherwise(F.col("p_name")))
    return entity(p), entity(after)


_DIFF = """WITH b0 AS (SELECT p_type AS kind, p_name AS name, p_brand AS signature, CAST(p_size AS VARCHAR) AS body FROM part),
a0 AS (SELECT p_type AS kind, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' renamed' ELSE p_name END AS name, p_brand AS signature, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS body FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY signature, body) AS nth FROM b0), a AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY signature, body) AS nth FROM a0),
p AS (SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.name, a.name) AS name, CASE WHEN b.nth IS NULL THEN 'added' WHEN a.nth IS NULL THEN 'removed' WHEN b.signature <> a.signature THEN 'signature_changed' WHEN b.body <> a.body THEN 'body_changed' ELSE 'unchanged' END AS change,
b.signature AS old_signature, a.signature AS new_signature FROM b FULL JOIN a ON b.kind = a.kind AND b.name = a.name AND b.nth = a.nth)"""


@query(_DIFF + " SELECT * FROM p")
def entity_pairing(spark, d):
    return diff.pair(*_versions(spark, d), ["kind", "name"])


@query(_DIFF + " SELECT kind, change, count(*) AS n FROM p GROUP BY kind, change")
def semantic_diff(spark, d):
    return entity_pairing(spark, d).groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n"))


_RENAME = """WITH b AS (SELECT p_partkey AS id, p_type AS kind, p_name AS name, p_brand AS brand FROM part),
n AS (SELECT id + 1000000000 AS id, id AS was, kind, CASE WHEN id % 3 = 0 THEN name || ' renamed' ELSE name END AS name, brand FROM b WHERE id % 7 <> 0),
r AS (SELECT id, kind, list_distinct(string_split(name || ' ' || brand || ' k' || id, ' ')) AS t FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.was = b.id AND n.name = b.name)),
a AS (SELECT id, kind, list_distinct(string_split(name || ' ' || brand || ' k' || was, ' ')) AS t FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE n.was = b.id AND n.name = b.name)),
s AS (SELECT r.id AS old_id, a.id AS new_id, len(list_intersect(r.t, a.t)) / (len(r.t) + len(a.t) - len(list_intersect(r.t, a.t))) AS exact FROM r JOIN a ON r.kind = a.kind),
k AS (SELECT *, round(exact, 4) AS similarity, row_number() OVER (PARTITION BY old_id ORDER BY round(exact, 4) DESC, new_id) AS n FROM s WHERE exact >= 0.6)
SELECT old_id, new_id, similarity FROM k WHERE n = 1"""


@query(_RENAME)
def rename_match(spark, d):
    """Both versions of the whole table: in the later one some parts are gone and some have another name."""
    before = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    after = before.filter("id % 7 <> 0").withColumns({"was": F.col("id"), "name": F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" renamed"))).otherwise(F.col("name"))})
    tokens = lambda key: F.split(F.concat("name", F.lit(" "), "brand", F.lit(" k"), key), " ")
    left, came = after.select(F.col("was").alias("id"), "name"), before.select(F.col("id").alias("was"), "name")
    removed = before.join(unbroadcast(left), ["id", "name"], "left_anti").select("id", "kind", tokens("id").alias("tokens"))
    added = after.join(unbroadcast(came), ["was", "name"], "left_anti").select((F.col("was") + 1000000000).alias("id"), "kind", tokens("was").alias("tokens"))
    return diff.rename_candidates(removed, added, 0.6)


@query(f"WITH n AS (SELECT DISTINCT unnest({TERMS}) AS name FROM benchmark), m AS (SELECT doc_id, unnest(list_distinct({TERMS})) AS name FROM documents) SELECT name, count(doc_id) AS dependents FROM n LEFT JOIN m USING (name) GROUP BY name")
def dependents_count(spark, d):
    names = tables.table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("name"))
    return diff.dependents(names, tables.table(spark, d, "documents"))


@query("WITH df AS (SELECT p_partkey AS id, p_name AS name, p_brand AS scope, p_type AS grp FROM part), c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, p_name AS name, CASE WHEN l_linenumber = 1 THEN p_brand ELSE 'none' END AS scope, CASE WHEN l_linenumber <= 2 THEN p_type ELSE 'none' END AS grp FROM lineitem JOIN part ON l_partkey = p_partkey), t1 AS (SELECT name, scope, count(*) AS n, min(id) AS id FROM df GROUP BY ALL), t2 AS (SELECT name, grp, count(*) AS n, min(id) AS id FROM df GROUP BY ALL), t3 AS (SELECT name, count(*) AS n, min(id) AS id FROM df GROUP BY ALL), j AS (SELECT call_id, CASE WHEN t1.n IS NOT NULL THEN 1 WHEN t2.n IS NOT NULL THEN 2 WHEN t3.n IS NOT NULL THEN 3 END AS tier, coalesce(t1.n, t2.n, t3.n) AS n, coalesce(t1.id, t2.id, t3.id) AS to_id FROM c LEFT JOIN t1 ON c.name = t1.name AND c.scope = t1.scope LEFT JOIN t2 ON c.name = t2.name AND c.grp = t2.grp LEFT JOIN t3 ON c.name = t3.name) SELECT call_id, to_id, CAST(CASE tier WHEN 1 THEN 0.92 WHEN 2 THEN 0.80 ELSE 0.68 END AS DOUBLE) AS confidence, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'package' ELSE 'name_only' END AS resolution FROM j WHERE n = 1")
def call_resolution_ladder(spark, d):
    """Lines of orders call parts by name: within their brand, within their type, or globally."""
    p = tables.table(spark, d, "part")
    defs = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("scope"), F.col("p_type").alias("grp"))
    l = tables.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    calls = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("p_name").alias("name"), F.when(F.col("l_linenumber") == 1, F.col("p_brand")).otherwise("none").alias("scope"), F.when(F.col("l_linenumber") <= 2, F.col("p_type")).otherwise("none").alias("grp"))
    return graph.resolve_ladder(calls, defs)


# code graph, sinks, streaming ------------------------------------------------------------------


@query()
def code_symbols(spark, d):
    """Symbols of the small source tree that the package carries."""
    return code.symbols(code.example_files(spark))


@query()
def code_relations(spark, d):
    return code.relations(code.example_files(spark)).select("from_id", "to_id", "type", "confidence", "resolution")


@query()
def snapshot_roundtrip(spark, d):
    """Relations written as newline-delimited JSON with header and summary and read back under the fixed schema."""
    from loomgraph.sources import snapshot

    return snapshot.read_relations(spark, snapshot.write(code.example_files(spark))).select("from_id", "to_id", "type", "confidence")


@query("WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM g GROUP BY user_id, s")
def events_sessions(spark, d):
    """An extension: sessions of events at most 30 minutes apart."""
    return sessions.sessions(tables.table(spark, d, "events"))


from loomgraph.plans import versions  # noqa: E402, F401  registers its queries
