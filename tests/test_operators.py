"""Operators that SQL can't express, against plain Python; decision tables of path, ignore and query-term rules."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import diff, queryterms, ranges, versions
from loomgraph.sources import history

ENTITY = "id long, path string, kind string, name string, signature string, body string, fingerprint string, pos long"


def entities(rng, n, first):
    words = ["get", "put", "alpha", "beta", "gamma", "delta", "x", "y", "z", "int", "str", "list"]
    out = []
    for i in range(n):
        signature = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 14])))
        out.append((first + i, f"f{rng.randrange(4)}", rng.choice("mc"), f"n{rng.randrange(5)}", signature, rng.choice(["", "b1", "b2", f"u{i}"]), rng.choice(["", "", "p1", f"q{i}"]), first + i))
    return out


def as_dict(row):
    return dict(zip([c.split()[0] for c in ENTITY.split(", ")], row))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moves_follow_the_order(spark, seed):
    rng = random.Random(seed)
    removed, added = entities(rng, 40, 0), entities(rng, 40, 1000)
    used, expected = set(), set()
    for r in map(as_dict, removed):
        scored = sorted(((-versions.similarity(r, a), a["id"]) for a in map(as_dict, added) if a["id"] not in used and a["path"] != r["path"] and a["kind"] == r["kind"]))
        scored = [(-s, i) for s, i in scored if -s >= versions.THRESHOLD]
        if not scored:
            continue
        unsure = len(scored) > 1 and round(scored[0][0] - scored[1][0], 6) < versions.MARGIN
        expected.add((r["id"], scored[0][1], scored[0][0], unsure))
        if not unsure:
            used.add(scored[0][1])
    table = lambda rows: spark.createDataFrame(rows, ENTITY)
    got = versions.reconcile_moves(versions.move_candidates(table(removed), table(added))).collect()
    assert {tuple(r) for r in got} == expected
    assert versions.reconcile_moves(versions.move_candidates(table([]), table(added))).count() == 0


def test_renames_take_the_best_that_is_left(spark):
    rng = random.Random(4)
    removed, added = entities(rng, 60, 0), entities(rng, 60, 1000)
    expected, left = set(), [as_dict(a) for a in added]
    for r in map(as_dict, removed):
        best, score = None, 0.0
        for a in left:
            if (a["path"], a["kind"]) == (r["path"], r["kind"]) and (s := versions.similarity(r, a)) > score:
                best, score = a, s
        if best and score >= versions.THRESHOLD:
            left.remove(best)
            expected.add((r["pos"], best["pos"], score))
    got = versions.renames(spark.createDataFrame(removed, ENTITY), spark.createDataFrame(added, ENTITY)).collect()
    assert {(r.old_pos, r.new_pos, r.similarity) for r in got} == expected and expected


def test_pairing_of_duplicate_names(spark):
    make = lambda rows: spark.createDataFrame([("m", "f", *r) for r in rows], "kind string, name string, signature string, body string, fingerprint string, pos int")
    before = make([("s1", "b1", "p1", 1), ("s1", "b2", "p2", 2), ("s2", "b3", "p3", 3), ("s3", "b4", "", 4)])
    after = make([("s1", "b2", "p2", 1), ("s1", "b1", "p1", 2), ("s9", "b3", "p3", 3), ("s4", "b5", "", 4), ("s5", "b6", "", 5)])
    got = {(r["old_pos"], r["new_pos"], r["pass"]) for r in versions.paired(before, after).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 3, 5), (4, 4, 8), (None, 5, None)}


def test_change_text(spark):
    rows = [("added", "fn", "a", None, None, 3), ("removed", "fn", "b", None, None, 1), ("renamed", "fn", "c", "old", None, 2), ("moved", "fn", "d", "was", "x.py", None), ("body_changed", "fn", "e", None, None, 0)]
    table = spark.createDataFrame(rows, "change string, kind string, name string, old_name string, old_path string, n int")
    line = versions.change_text(*[F.col(c) for c in ("change", "kind", "name", "old_name", "old_path", "n")])
    assert [r[0] for r in table.select(line).collect()] == [
        "+ fn a added", "- fn b removed (1 dependent)", "~ fn c renamed from old (2 dependents)", "~ fn d (renamed from was) moved from x.py (0 dependents)", "~ fn e body changed (0 dependents)",
    ]


@pytest.mark.parametrize(("context", "most"), [(0, 1), (1, 4), (3, 10)])
def test_capped_regions_equal_a_fold(spark, context, most):
    rng = random.Random(context)
    hits = {(d, rng.randint(1, 60)) for d in range(6) for _ in range(rng.randint(0, 25))}
    expected = set()
    for d in range(6):
        group = None
        for line in [*sorted(x for k, x in hits if k == d), 10**9]:
            if group and line - group[1] <= 2 * context + 1 and line - group[0] < most:
                group[1] = line
                continue
            if group:
                start = max(1, group[0] - context)
                expected.add((d, start, min(group[1] + context, start + most - 1)))
            group = [line, line]
    got = ranges.capped_regions(spark.createDataFrame(sorted(hits), "doc_id long, line int"), context, most).collect()
    assert {tuple(r) for r in got} == expected


def test_ignore_rules(spark):
    rules = ["# note", "", "*.log", "!keep.log", "/build", "node_modules/", "doc/*.txt", "a/**/z", "tmp[0-9]?", r"\#odd", "dir/**", "!dir/in/"]
    table = {
        "x.log": True, "a/b/y.log": True, "keep.log": False, "build": True, "build/out.o": True, "src/build": False, "node_modules": False, "p/node_modules/q.js": True, "doc/a.txt": True,
        "doc/sub/a.txt": False, "a/z": True, "a/b/c/z": True, "tmp1x": True, "tmpx1": False, "#odd": True, "dir/f": True, "dir/in/f": True, "plain": False,
    }
    rows = spark.createDataFrame([(p,) for p in table], "path string")
    assert {r.path: r.i for r in rows.select("path", paths.ignored(F.col("path"), rules).alias("i")).collect()} == table
    included = rows.select("path", paths.ignored(F.col("path"), rules, ["*.txt"]).alias("i")).collect()
    assert not next(r.i for r in included if r.path == "doc/a.txt")


def test_vendored_and_priors(spark):
    rows = spark.createDataFrame([("a/node_modules/x.js", True), ("build/x.c", True), ("build/x.c", False), ("src/vendors.py", False), ("deps", False)], "path string, tracked boolean")
    assert [r[0] for r in rows.select(paths.vendored(F.col("path"), F.col("tracked"))).collect()] == [True, False, True, False, True]
    score = lambda path, **asked: spark.range(1).select(paths.prior(F.lit(path), asked)).first()[0]
    assert score("src/a.py") == 0.5 and score("tests/a.py") == -12 and score("tests/a.py", test=1.0) == 0 and score("src/a_test.go") == -11.5
    assert score(".github/workflows/x.yml") == -6 and score(".github/x.yml", ci=1.0) == -12 and score("README.md") == -6 and score("README.md", docs=2.5) == 0
    assert score("dist/app.min.js") == -6 and score("lib/third_party/x.c") == -4.5


def test_question_terms():
    assert queryterms.parse("Fix the parseURL error") == {"fix": 1.0, "parseurl": 2.5, "parse": 1.1, "url": 1.1, "error": 1.0}
    assert queryterms.parse("HTTP")["http"] == 1.4 and queryterms.parse("max_rows")["max_rows"] == 2.5 and queryterms.parse("max_rows")["rows"] == 1.1
    found = queryterms.parse("parsing failures")
    assert found["pars"] == found["parse"] == found["failure"] == 0.55 and found["parsing"] == 1.0
    assert len(queryterms.parse(" ".join(f"word{i}" for i in range(300)))) == queryterms.TERMS


def test_history_skips_large_commits_and_binary_texts(spark):
    changes = spark.createDataFrame([(c, p) for c, ps in {1: "ab", 2: "ab", 3: "abcd", 4: "cd"}.items() for p in ps], "commit int, path string")
    assert {tuple(r) for r in history.cochanges(changes, 3, 1, 10).collect()} == {("a", "b", 2), ("c", "d", 1)}
    texts = spark.createDataFrame([(1, "AbC"), (2, "a\x00bc"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.pattern) for r in history.grep(texts, ["ABC", "b"]).collect()] == [(1, "abc"), (1, "b"), (2, "b")]
    assert [r.doc_id for r in history.grep(texts, ["b"], binary=False).collect()] == [1]


def test_joins_of_moves_stay_off_the_driver(spark):
    rng = random.Random(6)
    table = lambda rows: spark.createDataFrame(rows, ENTITY)
    found = versions.move_candidates(table(entities(rng, 20, 0)), table(entities(rng, 20, 1000)))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_rename_candidates_by_size_equal_brute_force(spark, threshold):
    rng = random.Random(7)
    def side(first):
        out = []
        for i in range(120):
            base = random.Random(i // 2).sample(range(90), rng.choice([1, 2, 4, 5, 15, 17, 30, 60]))
            out.append((first + i, "k", [f"t{x}" for x in base if rng.random() < 0.9] + [f"own{first + i}"] * rng.choice([0, 1])))
        return out

    removed, added = side(0), side(1000)
    want = set()
    for i, _, a in removed:
        scored = [(-round(len({*a} & {*b}) / len({*a} | {*b}), 4), j) for j, _, b in added if a and b and len({*a} & {*b}) / len({*a} | {*b}) >= threshold]
        want |= {(i, min(scored)[1])} if scored else set()
    table = lambda rows: spark.createDataFrame(rows, "id long, kind string, tokens array<string>")
    found = diff.rename_candidates(table(removed), table(added), threshold)
    assert {(r.old_id, r.new_id) for r in found.collect()} == want and len(want) > 10
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_bm25_top_moves_no_terms(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    from loomgraph.operators import search

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "é", "x1", "gamma,", "delta"]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(1, "alpha"), (1, "x1"), (2, "gamma"), (2, "gamma"), (3, "nowhere")]
    cut = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    average = sum(max(1, len(t)) for t in cut.values()) / len(cut)
    df = Counter(t for words in cut.values() for t in set(words))
    want = set()
    for q in (1, 2, 3):
        asked, scored = {t for i, t in queries if i == q}, []
        for i, words in cut.items():
            tf = Counter(w for w in words if w in asked)
            if tf:
                score = sum(math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / average)) for t, n in tf.items())
                scored.append((-round(score, 4), i, len(tf)))
        want |= {(q, i, -s, m, k) for k, (s, i, m) in enumerate(sorted(scored)[:7], 1)}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query long, term string")
    for cells in (search.CELLS, 9):
        monkeypatch.setattr(search, "CELLS", cells)
        found = search.bm25_top(table, asked, 7)
        assert {(r["query"], r.doc_id, r.score, r.matched, r["rank"]) for r in found.collect()} == want
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert search.bm25_top(table.limit(0), asked, 7).count() == 0 == search.bm25_top(table, asked.limit(0), 7).count()


def test_edges_are_aggregated_in_parts_by_size(spark, sf, monkeypatch):
    from loomgraph import session
    from loomgraph.sources import tables

    parts = lambda: tables.edges(spark, sf).filter("type = 'CONTAINS'").rdd.getNumPartitions()
    few = parts()
    monkeypatch.setattr(session, "PART_BYTES", session.PART_BYTES // 5000, raising=False)
    assert parts() > few
