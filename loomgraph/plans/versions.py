"""Registered queries of the diff, interval, history and search-expression operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.functions import text as T
from loomgraph.operators import queryterms, ranges, search, versions
from loomgraph.plans.catalogue import LOW, query
from loomgraph.sources import history, tables

# two versions of part: every row takes part; some are gone, some renamed, some have another body or signature


def _entities(p):
    return p.select(F.concat(F.lit("src/"), "p_brand").alias("path"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("sig").alias("signature"), F.col("p_size").cast("string").alias("body"), F.col("print").alias("fingerprint"), F.col("p_partkey").alias("pos"))


def _versions(spark, d):
    p = tables.table(spark, d, "part").withColumn("sig", F.concat_ws(" ", "p_brand", (F.col("p_partkey") % 4).cast("string"))).withColumn("print", (F.col("p_partkey") % 9).cast("string"))
    key = F.col("p_partkey")
    after = p.filter(key % 7 != 0).withColumns({
        "p_size": F.when(key % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_name": F.when(key % 11 == 0, F.concat("p_name", F.lit(" renamed"))).otherwise(F.col("p_name")),
        "sig": F.when(key % 13 == 0, F.concat("sig", F.lit(" more"))).otherwise(F.col("sig")), "print": F.when(key % 3 == 0, "").otherwise(F.col("print")),
    })
    return _entities(p), _entities(after)


def _pass_sql() -> str:
    old = "'src/' || p_brand AS path, p_type AS kind, p_name AS name, p_brand || ' ' || CAST(p_partkey % 4 AS VARCHAR) AS signature, CAST(p_size AS VARCHAR) AS body, CAST(p_partkey % 9 AS VARCHAR) AS fingerprint, p_partkey AS pos, 0 AS side"
    new = "'src/' || p_brand, p_type, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' renamed' ELSE p_name END, p_brand || ' ' || CAST(p_partkey % 4 AS VARCHAR) || CASE WHEN p_partkey % 13 = 0 THEN ' more' ELSE '' END, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 9 AS VARCHAR) END, p_partkey, 1"
    parts = [f"r0 AS (SELECT {old}, CAST(NULL AS INTEGER) AS pass, CAST(NULL AS VARCHAR) AS slot FROM part UNION ALL SELECT {new}, NULL, NULL FROM part WHERE p_partkey % 7 <> 0)"]
    for n, (evidence, filled, unique) in enumerate(versions.PASSES, 1):
        ready = " AND ".join(["pass IS NULL", *[f"{c} <> ''" for c in filled]])
        group = ", ".join(["path", "kind", "name", "ready", *evidence])
        fits = "b = 1 AND a = 1" if unique else "nth <= least(a, b)"
        slot = " || '|' || ".join([*evidence, "CAST(nth AS VARCHAR)"])
        parts.append(f"w{n} AS (SELECT *, ({ready}) AS ready FROM r{n - 1})")
        parts.append(f"v{n} AS (SELECT *, row_number() OVER (PARTITION BY {group}, side ORDER BY pos) AS nth, sum(1 - side) OVER (PARTITION BY {group}) AS b, sum(side) OVER (PARTITION BY {group}) AS a FROM w{n})")
        parts.append(f"r{n} AS (SELECT path, kind, name, signature, body, fingerprint, pos, side, CASE WHEN ready AND {fits} THEN {n} ELSE pass END AS pass, CASE WHEN ready AND {fits} THEN {slot} ELSE slot END AS slot FROM v{n})")
    last = f"r{len(versions.PASSES)}"
    parts.append(f"p AS (SELECT path, kind, name, pass, max(signature) FILTER (side = 0) AS old_signature, max(signature) FILTER (side = 1) AS new_signature, max(body) FILTER (side = 0) AS old_body, max(body) FILTER (side = 1) AS new_body, max(pos) FILTER (side = 0) AS old_pos, max(pos) FILTER (side = 1) AS new_pos FROM {last} GROUP BY path, kind, name, pass, slot, CASE WHEN pass IS NULL THEN pos * 2 + side END)")
    parts.append("c AS (SELECT *, CASE WHEN old_pos IS NULL THEN 'added' WHEN new_pos IS NULL THEN 'removed' WHEN old_signature <> new_signature THEN 'signature_changed' WHEN old_body <> new_body THEN 'body_changed' END AS change FROM p)")
    return "WITH " + ", ".join(parts)


_PAIRED = _pass_sql()


def _paired(spark, d):
    return versions.paired(*_versions(spark, d), ("path",))


@query(_PAIRED + " SELECT path, kind, name, coalesce(pass, 0) AS pass, coalesce(old_pos, -1) AS old_pos, coalesce(new_pos, -1) AS new_pos, coalesce(change, 'unchanged') AS change FROM c")
def entity_pairing_passes(spark, d):
    """Every entity of both versions with the pass that paired it and the change it makes."""
    return _paired(spark, d).select("path", "kind", "name", *[F.coalesce(c, F.lit(n)).alias(c) for c, n in (("pass", 0), ("old_pos", -1), ("new_pos", -1))], F.coalesce(versions.change_of(), F.lit("unchanged")).alias("change"))


@query(_PAIRED + " SELECT path, change, count(*) AS n FROM c WHERE change IS NOT NULL AND path NOT IN (SELECT 'src/' || p_brand FROM part WHERE p_partkey % 997 = 1) GROUP BY path, change")
def parse_failure_suppression(spark, d):
    """Changes by file, without the files that one version failed to parse (here: those of every 997th part)."""
    failures = tables.table(spark, d, "part").filter("p_partkey % 997 = 1").select(F.concat(F.lit("src/"), "p_brand").alias("path"))
    changes = _paired(spark, d).withColumn("change", versions.change_of()).filter("change is not null")
    return versions.without_failures(changes, failures).groupBy("path", "change").agg(F.count(F.lit(1)).alias("n"))


_TEXT = _PAIRED + """, m AS (SELECT l_partkey AS pos, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)
SELECT path, coalesce(new_pos, old_pos) AS pos, CASE change WHEN 'added' THEN '+ ' || kind || ' ' || name || ' added'
  ELSE CASE change WHEN 'removed' THEN '- ' || kind || ' ' || name || ' removed' ELSE '~ ' || kind || ' ' || name || ' ' || replace(change, '_', ' ') END
  || CASE WHEN coalesce(n, 0) = 1 THEN ' (1 dependent)' ELSE ' (' || CAST(coalesce(n, 0) AS VARCHAR) || ' dependents)' END END AS line
FROM c LEFT JOIN m ON m.pos = c.old_pos WHERE change IS NOT NULL"""


@query(_TEXT)
def diff_text(spark, d):
    """The diff as lines of text with the distinct suppliers of a part as its dependents."""
    used = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("used")).agg(F.count_distinct("l_suppkey").alias("n"))
    changes = _paired(spark, d).withColumn("change", versions.change_of()).filter("change is not null").join(used, F.col("old_pos") == F.col("used"), "left")
    line = versions.change_text(F.col("change"), F.col("kind"), F.col("name"), dependents=F.col("n"))
    return changes.select("path", F.coalesce("new_pos", "old_pos").alias("pos"), line.alias("line"))


@query(_PAIRED + ", x AS (SELECT DISTINCT path FROM c WHERE change IS NOT NULL), f AS (SELECT DISTINCT 'src/' || p_brand AS path FROM part UNION SELECT 'doc/' || n_name FROM nation) SELECT path, 'module' AS kind, path AS name, 'body_changed' AS change FROM f WHERE path NOT IN (SELECT path FROM x)")
def module_scope_changes(spark, d):
    """Files that count as changed although no entity of theirs did: documents on nations have none."""
    p = tables.table(spark, d, "part").select(F.concat(F.lit("src/"), "p_brand").alias("path")).unionByName(tables.table(spark, d, "nation").select(F.concat(F.lit("doc/"), "n_name").alias("path")))
    return versions.module_changes(p, _paired(spark, d).withColumn("change", versions.change_of()).filter("change is not null"))


@query()
def rename_reconciliation(spark, d):
    """Removed entities that come back under another name in their file."""
    changes = versions.paired(*_versions(spark, d), ("path",)).withColumn("change", versions.change_of())
    side = lambda change, p: changes.filter(F.col("change") == change).select("path", "kind", "name", *[F.col(f"{p}_{c}").alias(c) for c in ("signature", "body", "fingerprint", "pos")])
    return versions.renames(side("removed", "old"), side("added", "new"))


@query()
def move_reconciliation(spark, d):
    """Removed entities that come back in another file: parts whose brand is changed."""
    p, _ = _versions(spark, d)
    content = lambda df: df.select(F.col("pos").alias("id"), "path", "kind", F.concat_ws(" ", "name", "signature", F.concat(F.lit("k"), "pos")).alias("signature"), F.lit("").alias("body"), F.when(F.col("pos") % 2 == 0, F.concat_ws("-", "kind", "pos")).otherwise("").alias("fingerprint"))
    after = content(p).withColumn("path", F.concat(F.lit("lib/"), "path")).withColumn("id", F.col("id") + 10**12)
    return versions.reconcile_moves(versions.move_candidates(content(p), after))


# intervals and regions -------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), h AS (SELECT doc_id, line FROM l WHERE contains(t, 'the'))"
_WINDOWS = "n AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), wh AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 8) / 6) AS BIGINT)))) AS h FROM n), w AS (SELECT doc_id, CAST(h * 6 + 1 AS INTEGER) AS start_line, CAST(least(h * 6 + 8, n) AS INTEGER) AS end_line FROM wh)"


def _hits(spark, d):
    return search.lines_of(tables.table(spark, d, "documents")).filter(F.contains("line_text", F.lit("the"))).select("doc_id", "line")


@query(f"WITH {_LINES}, {_WINDOWS}, j AS (SELECT h.doc_id, h.line, start_line, end_line, row_number() OVER (PARTITION BY h.doc_id, h.line ORDER BY end_line - start_line, start_line, end_line) AS k FROM h JOIN w ON h.doc_id = w.doc_id AND h.line BETWEEN start_line AND end_line) SELECT DISTINCT doc_id, line, start_line, end_line FROM j WHERE k = 1")
def enclosing_region(spark, d):
    """The smallest window around every hit line: an interval join by blocks of lines."""
    return ranges.enclosing(_hits(spark, d), search.line_windows(tables.table(spark, d, "documents"), 8, 6))


@query(f"WITH {_WINDOWS}, r AS (SELECT doc_id, start_line AS id, start_line, end_line FROM w), p AS (SELECT a.doc_id, a.id AS left, b.id AS right, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1 AS lines, least(a.end_line - a.start_line, b.end_line - b.start_line) + 1 AS shorter FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.id < b.id) SELECT doc_id, left, right, lines FROM p WHERE lines > 0 AND lines >= 0.25 * shorter".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"').replace(", left, right,", ', "left", "right",'))
def overlapping_regions(spark, d):
    """Windows that share a quarter of the shorter one's lines."""
    windows = search.line_windows(tables.table(spark, d, "documents"), 8, 6).withColumn("id", F.col("start_line"))
    return ranges.overlapping(windows, windows, 0.25)


@query()
def hit_regions_capped(spark, d):
    return ranges.capped_regions(_hits(spark, d), 2, 20)


_REGIONS = f"WITH {_LINES}, m AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= 3 THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS region FROM m), r AS (SELECT doc_id, CAST(greatest(1, min(line) - 1) AS INTEGER) AS start_line, CAST(max(line) + 1 AS INTEGER) AS end_line FROM g GROUP BY doc_id, region), b AS (SELECT *, lead(start_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line) AS next FROM r)"


@query(_REGIONS + " SELECT doc_id, end_line + 1 AS start_line, next - 1 AS end_line FROM b WHERE next - end_line - 1 BETWEEN 1 AND 4")
def region_bridges(spark, d):
    """Gaps of at most four lines between neighbouring regions."""
    return ranges.bridges(search.hit_regions(_hits(spark, d), 1), 4)


@query(f"WITH {_LINES.split(', h AS')[0]}, s AS (SELECT doc_id, line, len(regexp_extract_all(t, 'the')) AS weight FROM l), b AS (SELECT *, max(line) OVER (PARTITION BY doc_id) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, line) AS k FROM s) SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(weight AS INTEGER) AS weight, CAST(greatest(1, line - 3) AS INTEGER) AS start_line, CAST(least(line + 3, last) AS INTEGER) AS end_line FROM b WHERE k = 1 AND weight > 0")
def focus_line(spark, d):
    """The line of each document that says `the` most often, with three lines around it."""
    return ranges.focus_lines(search.lines_of(tables.table(spark, d, "documents")), F.size(F.regexp_extract_all("line_text", F.lit("(the)"), F.lit(1))), 3)


# history: orders as commits, their parts as files ----------------------------------------------

_COMMITS = "c AS (SELECT o_orderkey AS commit, o_custkey AS branch, o_orderdate AS made FROM orders)"


def _commits(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("branch"), F.col("o_orderdate").alias("made"))


def _paths(spark, d):
    return tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part/"), "l_partkey").alias("path")).distinct()


@query(f"WITH {_COMMITS}, n AS (SELECT * FROM c ORDER BY made DESC, commit DESC LIMIT 256) SELECT DISTINCT n.commit, made, 'part/' || l_partkey AS path FROM n JOIN lineitem ON l_orderkey = n.commit")
def history_scan(spark, d):
    """Commit and path of the 256 newest commits."""
    return history.scan(_commits(spark, d), _paths(spark, d), 256)


@query(f"WITH {_COMMITS} SELECT commit, coalesce(lag(commit) OVER (PARTITION BY branch ORDER BY made, commit), -1) AS parent FROM c")
def first_parents(spark, d):
    return history.first_parents(_commits(spark, d)).select("commit", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("WITH m AS (SELECT event_id AS commit, ts AS made, 'work' || chr(10) || chr(10) || 'Checkpoint: cp' || user_id AS message FROM events), t AS (SELECT *, regexp_extract(message, '(?m)^Checkpoint: (.+)$', 1) AS checkpoint FROM m) SELECT checkpoint, max(commit) FILTER (newest) AS commit FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint ORDER BY made DESC, commit DESC) = 1 AS newest FROM t) GROUP BY checkpoint")
def checkpoint_lookup(spark, d):
    """The newest commit whose trailer names each checkpoint."""
    e = tables.table(spark, d, "events")
    commits = e.select(F.col("event_id").alias("commit"), F.col("ts").alias("made"), F.concat(F.lit("work\n\nCheckpoint: cp"), "user_id").alias("message"))
    return history.by_checkpoint(commits, "Checkpoint")


@query(f"WITH {_COMMITS}, n AS (SELECT commit FROM c ORDER BY made DESC, commit DESC LIMIT 2000), f AS (SELECT DISTINCT n.commit, 'part/' || l_partkey AS path FROM n JOIN lineitem ON l_orderkey = n.commit), s AS (SELECT commit FROM f GROUP BY commit HAVING count(*) <= 50), g AS (SELECT f.* FROM f JOIN s USING (commit)), p AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS commits FROM g a JOIN g b ON a.commit = b.commit AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM p ORDER BY commits DESC, path_a, path_b LIMIT 1000")
def history_cochanges(spark, d):
    """Files changed together at least twice in the 2000 newest commits of at most 50 files; the 1000 most frequent pairs."""
    return history.cochanges(history.scan(_commits(spark, d), _paths(spark, d), 2000), 50, 2, 1000)


_PATTERNS = ["license", "password", "the end", "http://", "e"]


@query(f"WITH p AS (SELECT unnest({_PATTERNS!r}) AS pattern) SELECT doc_id, pattern FROM documents, p WHERE contains({LOW}, pattern)")
def multi_pattern_scan(spark, d):
    """Fixed strings, without regard to the case of letters A to Z, in every text: one pass, no join."""
    return history.grep(tables.table(spark, d, "documents"), _PATTERNS).select("doc_id", "pattern")


# paths and search expressions ------------------------------------------------------------------

_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@query(f"WITH p AS (SELECT page_id, '/' || lower({_PATH}) AS p, regexp_extract('/' || lower({_PATH}), '[^/]*$') AS b FROM pages) SELECT page_id, CAST((CASE WHEN regexp_matches(p, '/(src|include|lib|packages)/') THEN 0.5 ELSE 0 END) + (CASE WHEN contains(p, '/.github/workflows/') THEN -6 WHEN contains(p, '/.github/') THEN -12 ELSE 0 END) + (CASE WHEN regexp_matches(p, '/(dependencies|third_party|third-party)/') THEN -5 ELSE 0 END) + (CASE WHEN regexp_matches(p, '/(tests?|testdata|fixtures|__tests__|spec)/|[._](test|spec)[.]|[.]test$') THEN -12 ELSE 0 END) + (CASE WHEN regexp_matches(p, '/(docs?|man|manual)/|[.](md|markdown|rst|adoc|txt|prebuilt|roff|man|[1-9])$') OR regexp_matches(b, '^(readme|changelog)') THEN -6 ELSE 0 END) + (CASE WHEN regexp_matches(p, '/(single_include|single-include|onefile|amalgamation|generated|dist|build|gen)/|amalgamat') OR regexp_matches(b, '[._]generated[.]|^generated_|[.]min[.]js$') THEN -6 ELSE 0 END) AS DOUBLE) AS prior FROM p")
def path_priors_full(spark, d):
    """All path priors over the pages' paths."""
    p = tables.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return p.select("page_id", P.prior(F.col("path")).alias("prior"))


@query(f"SELECT page_id, regexp_matches('/' || {_PATH} || '/', '/(node_modules|vendor|third_party|third-party|bower_components|site-packages|build|dist|deps|docs)/') AS pruned FROM pages")
def vendored_pruning(spark, d):
    """Paths below vendored directories; build, dist, deps and docs count since nothing here is tracked."""
    p = tables.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return p.select("page_id", P.vendored(F.col("path"), F.lit(False), extra=("docs",)).alias("pruned"))


_SPARSE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"


@query(f"WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), ' ') AS w FROM documents), t AS (SELECT doc_id, unnest(list_filter(string_split(lower({_SPARSE}), ' '), lambda x: x <> '')) AS term FROM w) SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term")
def sparse_term_counts(spark, d):
    """Terms split at case changes, underscores and digits, counted by document."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.explode(T.sparse_terms(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS seen FROM documents), v AS (SELECT lang, count(*) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY lang) SELECT lang, v AS observed, CAST(CASE WHEN seen = 0 OR v = 0 THEN v ELSE ceil(CAST(v AS DOUBLE) * total / seen) END AS BIGINT) AS scaled FROM v, s")
def corpus_scaling(spark, d):
    """Counts of a partial scan carried over to the whole corpus (here the scan that stopped after a third of the files)."""
    docs = tables.table(spark, d, "documents")
    sums = docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id") % 3 == 0).alias("seen"))
    seen = docs.filter("doc_id % 3 = 0").groupBy("lang").agg(F.count(F.lit(1)).alias("observed"))
    return seen.crossJoin(F.broadcast(sums)).select("lang", "observed", T.scaled(F.col("observed"), F.col("total"), F.col("seen")).alias("scaled"))


@query("SELECT type, resolution, band, count(*) AS n FROM (SELECT 'SUPPLIED_BY' AS type, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'import_resolved' ELSE 'name_only' END AS resolution, CASE WHEN 1 - l_discount >= 0.95 THEN 'high' ELSE 'low' END AS band FROM lineitem) GROUP BY CUBE (type, resolution, band)")
def coverage_histogram(spark, d):
    """Counts by type, resolution and band and all their margins, in one pass."""
    l = tables.table(spark, d, "lineitem")
    resolution = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "import_resolved").otherwise("name_only")
    rows = l.select(F.lit("SUPPLIED_BY").alias("type"), resolution.alias("resolution"), F.when(1 - F.col("l_discount") >= 0.95, "high").otherwise("low").alias("band"))
    return rows.cube("type", "resolution", "band").agg(F.count(F.lit(1)).alias("n"))


_QUESTION = "the onThing HTTP parsing of password tokens"


def _term_sql() -> str:
    return ", ".join(f"('{t}', CAST({w} AS DOUBLE))" for t, w in queryterms.parse(_QUESTION).items())


@query(f"WITH q(term, weight) AS (VALUES {_term_sql()}), s AS (SELECT doc_id, sum(CASE WHEN contains({LOW}, term) THEN weight ELSE 0 END) AS score FROM documents, q GROUP BY doc_id) SELECT doc_id, round(score, 4) AS score FROM s ORDER BY round(score, 4) DESC, doc_id LIMIT 100")
def file_preselection(spark, d):
    """The 100 documents that hold most of the question's weighted terms."""
    return search.preselect(tables.table(spark, d, "documents"), queryterms.parse(_QUESTION), 100)


@query(f"WITH q(term, weight) AS (VALUES {_term_sql()}), p AS (SELECT page_id, lower({_PATH}) AS p, lower(regexp_extract({_PATH}, '[^/]*$')) AS b FROM pages) SELECT page_id, round(sum(CASE WHEN weight <> 1 AND weight < 1.25 THEN 0 WHEN contains(b, term) THEN 2.5 * weight WHEN contains(p, term) THEN 1.25 * weight ELSE 0 END), 4) AS score FROM p, q GROUP BY page_id")
def path_score(spark, d):
    """Weighted terms in base names and paths."""
    p = tables.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return p.select("page_id", F.round(P.path_score(F.col("path"), queryterms.parse(_QUESTION)), 4).alias("score"))
