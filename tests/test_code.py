"""The code graph over a small tree with hand-derived edges, and helpers without SQL."""

import pytest

from loomgraph.operators import search, similarity
from loomgraph.sources import code, snapshot


@pytest.fixture(scope="module")
def edges(spark):
    return {(r.from_id.split(":", 1)[1], r.to_id.split(":", 1)[1], r.type): (r.confidence, r.resolution) for r in code.relations(code.example_files(spark)).collect()}


@pytest.mark.parametrize(("source", "target", "kind", "expected"), [
    ("Python:shop/cart.py:class:Cart", "Python:shop/cart.py:class:Base", "EXTENDS", (0.9, "exact")),
    ("Python:shop/cart.py:class:Cart", "Python:shop/cart.py:class:Base", "INHERITS", (0.9, "exact")),
    ("Python:shop/cart.py:method:Cart.size", "Python:shop/cart.py:method:Base.size", "OVERRIDES", (0.85, "exact")),
    ("Python:shop/cart.py:method:Cart.pay", "Python:shop/cart.py:method:Cart.size", "CALLS", (0.9, "exact")),
    ("Python:shop/cart.py:method:Cart.pay", "Python:shop/price.py:function:total", "CALLS", (0.86, "import_resolved")),
    ("Python:shop/cart.py:method:Cart.pay", "symbol:os.getcwd", "CALLS", (0.78, "import_external")),
    ("Python:shop/cart.py:function:make", "Python:shop/cart.py:class:Cart", "CONSTRUCTS", (0.92, "exact")),
    ("Python:shop/cart.py:function:test_make", "Python:shop/cart.py:function:make", "TESTS", (0.8, "name_only")),
    ("file:shop/cart.py", "file:shop/price.py", "IMPORTS", (0.95, "import_resolved")),
    ("TypeScript:web/server.ts:class:Square", "TypeScript:web/server.ts:interface:Shape", "IMPLEMENTS", (0.9, "exact")),
    ("TypeScript:web/server.ts:function:start", "TypeScript:web/store.ts:function:load", "ASYNC_CALLS", (0.85, "exact")),
    ("TypeScript:web/server.ts:function:start", "route:/items/{id}", "HANDLES_ROUTE", (0.86, "pattern")),
    ("TypeScript:web/store.ts:function:load", "route:/items/{id}", "HTTP_CALLS", (0.7, "pattern")),
    ("TypeScript:web/server.ts:function:list", "channel:ready", "EMITS", (0.6, "pattern")),
    ("Go:api/main.go:function:main", "Go:api/work.go:function:work", "CALLS", (0.8, "package")),
])
def test_relations(edges, source, target, kind, expected):
    assert edges.get((source, target, kind)) == expected


MIXED = {
    "tools/json.go": "package tools\n\nfunc Encode() {}\n", "tools/other/utils.py": "def go():\n    pass\n",
    "app/main.py": "import json\nfrom pkg.utils import go\nfrom . import helper\nfrom app.shapes import Square as Sq, build\n\n\ndef run(s: Base):\n    json.dumps(1)\n    go()\n    helper.help_me()\n    q = Shape2()\n    q.area()\n    s.name()\n    build().area()\n    Sub().name()\n    made = build()\n    made.area()\n    unknown.area()\n",
    "app/helper.py": "def help_me():\n    pass\n",
    "app/shapes.py": "class Base:\n    def name(self):\n        return 1\n\n\nclass Sub(Base):\n    def go_up(self):\n        return self.name()\n\n\nclass Shape2:\n    def area(self):\n        return 2\n\n\nclass Square:\n    def area(self):\n        return 3\n\n\ndef build() -> Square:\n    return Square()\n",
    "go.mod": "module example.com/m\n", "cmd/main.go": "package main\n\nimport (\n\t\"fmt\"\n\t\"example.com/m/store\"\n)\n\nfunc main() {\n\tstore.Open()\n\tfmt.Println()\n}\n",
    "store/db.go": "package store\n\ntype DB struct {\n}\n\nfunc (d *DB) Close() {}\n\nfunc Open() *DB {\n\td := DB{}\n\td.Close()\n\treturn nil\n}\n",
    "j/src/com/x/A.java": "package com.x;\n\nimport com.x.B;\n\nclass A {\n  void run(B b) {\n    b.work();\n    new B().work();\n  }\n}\n", "j/src/com/x/B.java": "package com.x;\n\nclass B {\n  void work() {\n  }\n}\n",
    "w/a.ts": "import { load as pull } from './lib/b';\nimport * as c from './c';\nimport React from 'react';\n\nexport function go2() {\n  pull();\n  c.other();\n}\nboot();\nfunction boot() {\n}\n", "w/lib/b/index.ts": "export function load() {\n}\n", "w/c.ts": "export function other() {\n}\n",
    "f/flow.py": "def make(x):\n    return x\n\n\ndef other(x):\n    return x\n\n\ndef one(p):\n    return make(1)\n\n\ndef two(p):\n    q = p\n    other(q)\n    v = make(2)\n    return v\n",
    "f/acc.go": "package bank\n\ntype Account struct {\n\tID      string\n\tBalance int\n}\n\nfunc Start(name string) Account {\n\treturn Account{}\n}\n\nfunc (a *Account) Deposit(n int) {\n\tm := a.Balance + n\n\ta.Balance = m\n}\n\nfunc Look(acc *Account) *string {\n\treturn &acc.ID\n}\n",
    "t/main.tf": 'variable "cidr" {\n}\n\nresource "aws_vpc" "main" {\n  cidr_block = var.cidr\n}\n\nmodule "gw" {\n  vpc_id = aws_vpc.main.id\n}\n', "Dockerfile": "FROM a AS builder\nFROM b AS runtime\nCOPY --from=builder /x /y\n",
    "s/api.ts": "function graphqlFetch() {\n  return gql`\n    query GetUser {\n      user(id: 1) {\n        id\n      }\n    }\n  `;\n}\n\nfunction makeRouter() {\n  return router({\n    user: publicProcedure.input(z).query(() => {\n      return 1;\n    }),\n  });\n}\n",
    "s/auth.proto": "service Auth {\n  rpc Check (A) returns (B);\n}\n\nmessage A {\n  message In {\n  }\n}\n", "s/schema.graphql": "type Query {\n  user(id: ID): User\n}\n\ntype User {\n  id: ID\n}\n", "s/only_windows.go": "package s\n\nfunc win() {}\n",
    "r/src/lib.rs": "use crate::util::io;\n", "r/src/util.rs": "pub fn io() {}\n", "big.js": "x" * 2_000_000, "min.js": "y();" * 5000,
}


@pytest.fixture(scope="module")
def mixed(spark):
    found = code.relations(spark.createDataFrame(list(MIXED.items()), "path string, content string")).collect()
    short = lambda i: i.split(":", 1)[1] if i.startswith("repo:") else i
    return {(short(r.from_id), short(r.to_id), r.type): (r.confidence, r.resolution) for r in found}


@pytest.mark.parametrize(("source", "target", "kind", "expected"), [
    ("file:app/main.py", "external:import:json", "IMPORTS", (0.8, "name_only")), ("file:app/main.py", "external:import:pkg.utils", "IMPORTS", (0.8, "name_only")),
    ("file:app/main.py", "file:app/helper.py", "IMPORTS", (0.95, "import_resolved")), ("file:app/main.py", "file:app/shapes.py", "IMPORTS", (0.95, "import_resolved")),
    ("file:cmd/main.go", "file:store/db.go", "IMPORTS", (0.93, "import_resolved")), ("file:cmd/main.go", "external:import:fmt", "IMPORTS", (0.8, "name_only")),
    ("file:j/src/com/x/A.java", "file:j/src/com/x/B.java", "IMPORTS", (0.9, "import_resolved")), ("file:w/a.ts", "file:w/lib/b/index.ts", "IMPORTS", (0.95, "import_resolved")),
    ("file:w/a.ts", "external:import:react", "IMPORTS", (0.8, "name_only")), ("file:r/src/lib.rs", "file:r/src/util.rs", "IMPORTS", (0.95, "import_resolved")),
    ("Python:app/main.py:function:run", "external:symbol:json.dumps", "CALLS", (0.78, "import_external")), ("Python:app/main.py:function:run", "external:symbol:pkg.utils.go", "CALLS", (0.78, "import_external")),
    ("Python:app/main.py:function:run", "Python:app/helper.py:function:help_me", "CALLS", (0.86, "import_resolved")), ("Python:app/main.py:function:run", "Python:app/shapes.py:method:Shape2.area", "CALLS", (0.85, "type_inferred")),
    ("Python:app/main.py:function:run", "Python:app/shapes.py:method:Base.name", "CALLS", (0.83, "type_inferred")), ("Python:app/main.py:function:run", "Python:app/shapes.py:method:Square.area", "CALLS", (0.78, "type_inferred")),
    ("Python:app/shapes.py:method:Sub.go_up", "Python:app/shapes.py:method:Base.name", "CALLS", (0.82, "type_inferred")), ("Go:cmd/main.go:function:main", "Go:store/db.go:function:Open", "CALLS", (0.86, "import_resolved")),
    ("Go:store/db.go:function:Open", "Go:store/db.go:method:DB.Close", "CALLS", (0.85, "type_inferred")), ("Java:j/src/com/x/A.java:method:A.run", "Java:j/src/com/x/B.java:method:B.work", "CALLS", (0.83, "type_inferred")),
    ("TypeScript:w/a.ts:function:go2", "TypeScript:w/lib/b/index.ts:function:load", "CALLS", (0.86, "import_resolved")), ("TypeScript:w/a.ts:function:go2", "TypeScript:w/c.ts:function:other", "CALLS", (0.86, "import_resolved")),
    ("file:w/a.ts", "TypeScript:w/a.ts:function:boot", "CALLS", (0.92, "exact")),
    ("Python:f/flow.py:function:make", "Python:f/flow.py:function:one", "DATA_FLOWS", (0.75, "exact")), ("Python:f/flow.py:function:make", "Python:f/flow.py:function:two", "DATA_FLOWS", (0.75, "exact")),
    ("Python:f/flow.py:function:two", "Python:f/flow.py:function:other", "DATA_FLOWS", (0.7, "exact")), ("Python:f/flow.py:function:one", "Python:f/flow.py:function:make", "DATA_FLOWS", None),
    ("Go:f/acc.go:method:Account.Deposit", "Go:f/acc.go:field:Account.Balance", "READS_FIELD", (0.9, "type_inferred")), ("Go:f/acc.go:method:Account.Deposit", "Go:f/acc.go:field:Account.Balance", "WRITES_FIELD", (0.9, "type_inferred")),
    ("Go:f/acc.go:function:Look", "Go:f/acc.go:field:Account.ID", "ACCESSES", (0.83, "type_inferred")), ("Go:f/acc.go:type:Account", "Go:f/acc.go:field:Account.ID", "CONTAINS", (1.0, "exact")),
    ("Go:f/acc.go:function:Start", "Go:f/acc.go:type:Account", "RETURNS_TYPE", (0.85, "exact")), ("Go:f/acc.go:function:Look", "Go:f/acc.go:type:Account", "PARAM_TYPE", (0.85, "exact")), ("Go:f/acc.go:function:Look", "Go:f/acc.go:type:Account", "USES_TYPE", (0.85, "exact")),
    ("HCL:t/main.tf:block:resource.aws_vpc.main", "HCL:t/main.tf:block:variable.cidr", "RESOURCE_DEPENDS_ON", (0.9, "exact")), ("HCL:t/main.tf:block:module.gw", "HCL:t/main.tf:block:resource.aws_vpc.main", "RESOURCE_DEPENDS_ON", (0.9, "exact")),
    ("HCL:t/main.tf:block:resource.aws_vpc.main", "external:config:aws_vpc.main", "CONFIGURES", (0.9, "pattern")), ("Dockerfile:Dockerfile:stage:runtime", "Dockerfile:Dockerfile:stage:builder", "RESOURCE_DEPENDS_ON", (0.9, "exact")),
])
def test_imports_and_receivers(mixed, source, target, kind, expected):
    assert mixed.get((source, target, kind)) == expected


def test_nothing_is_resolved_by_a_file_stem(mixed):
    assert not [e for e in mixed if "tools/" in e[1] and e[2] != "DEFINES"]


def test_files_that_are_too_large_or_minified_fail(spark):
    rows = code.records(spark.createDataFrame(list(MIXED.items()), "path string, content string")).filter("record = 'FAILURE'").collect()
    assert {(r.path, r.name) for r in rows} == {("big.js", "E_FILE_TOO_LARGE"), ("min.js", "E_MINIFIED")}


def test_the_brace_scanner_is_linear():
    import time

    one = "function f%d(a) {\n  if (a) { g(a); }\n  return a.b.c(1);\n}\n"
    began = time.time()
    assert len(code.scan("x.js", "JavaScript", "".join(one % i for i in range(15000)))) >= 45000
    assert time.time() - began < 30


def test_symbols_of_formats(spark):
    found = {(r.file_path, r.kind, r.name) for r in code.symbols(code.example_files(spark)).collect()}
    assert {("Dockerfile", "stage", "build"), ("README.md", "section", "Shop"), ("api/main.go", "type", "Store")} <= found


def test_changed_files(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    before, after = make([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]), make([("a", "1"), ("b", "9"), ("e", "3"), ("f", "5")])
    assert {tuple(r) for r in code.changed_files(before, after).collect()} == {("M", "b", "b"), ("R", "c", "e"), ("D", "d", None), ("A", None, "f")}


def test_snapshot_key_ignores_order(spark):
    files = code.example_files(spark)
    assert snapshot.key(files) == snapshot.key(files.repartition(3)) != snapshot.key(files.limit(2))


def test_diverse_covers_files_first():
    rows = [{"path": p, "start": s, "end": s + 1, "score": v} for p, s, v in (("a", 1, 9.0), ("a", 5, 8.9), ("a", 9, 8.8), ("b", 1, 6.5))]
    assert [(r["path"], r["start"]) for r in search.diverse(rows, 3)] == [("a", 1), ("b", 1), ("a", 5)]
    assert sum(r["path"] == "a" for r in search.diverse(rows, 4)) == 2


def test_clone_pairs_are_similar(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    exact = {(r.left, r.right) for r in similarity.exact_pairs(docs, threshold=0.6).collect()}
    rep = {r.id: r.representative for r in similarity.clone_classes(docs).collect()}
    for r in similarity.clone_pairs(docs).collect():
        a, b = sorted((rep[r.left], rep[r.right]))
        assert a == b or (a, b) in exact


def test_flow_kinds_of_python():
    import ast

    from loomgraph.sources.flows import brace_flows, python_flows

    text = """
def f(p, r):
    a = p
    b = a
    c, d = p
    o = {"k": p}
    xs = [p]
    ys = []
    ys.append(p)
    z = Box()
    z.v = p
    e = r.field
    g1(p); g2(b); g3(c); g4(o); g5(xs); g6(ys); g7(z); g8(e); g9(r.field); g10({"k": p}); g11([p])
    for x in p:
        g12(x)
    if r:
        w = h1()
    else:
        w = h2()
    u, v = h3()
    t = 1 + h4()
    s = h5()
    if r: return w
    if r: return u
    if r: return t
    if r: return s
    if r: return s.name
    if r: return h6() if r else h7()
    if r: return h8() or h9()
    return h10(1)
"""
    got = {(n, kind.removesuffix("_flow")) for n, kind, _ in python_flows(ast.parse(text).body[0])}
    assert got >= {
        ("g1", "argument_forward"), ("g2", "alias_forward"), ("g3", "destructured_alias_forward"), ("g4", "object_literal_forward"), ("g5", "collection_literal_forward"), ("g6", "collection_element_forward"),
        ("g7", "object_field_forward"), ("g8", "parameter_property_alias_forward"), ("g9", "parameter_property_forward"), ("g10", "direct_literal_forward"), ("g11", "direct_literal_forward"), ("g12", "callback_element_forward"),
        ("h1", "branch_assigned_return"), ("h2", "branch_assigned_return"), ("h3", "destructured_return"), ("h4", "expression_assigned_return"), ("h5", "assigned_return"), ("h5", "property_assigned_return"),
        ("h6", "ternary_return"), ("h7", "ternary_return"), ("h8", "fallback_return"), ("h9", "fallback_return"), ("h10", "return"),
    }
    body = "{ const a = p; const v = h1(1); const { x, y } = h2(); g1(p); g2(a); g3(q.z); if (p) return v; if (q) return x; if (p) return c ? h3() : h4(); if (p) return h5() || h6(); return h7(); }"
    got = {(n, kind.removesuffix("_flow")) for n, kind, _ in brace_flows(body, "function f(p, q)", "f")}
    assert got >= {("g1", "argument_forward"), ("g2", "alias_forward"), ("g3", "parameter_property_forward"), ("h1", "assigned_return"), ("h2", "destructured_return"), ("h3", "ternary_return"), ("h4", "ternary_return"), ("h5", "fallback_return"), ("h6", "fallback_return"), ("h7", "return")}


@pytest.mark.parametrize(("path", "head", "built"), [
    ("a.go", "", True), ("a_windows.go", "", False), ("a_linux.go", "", True), ("a_linux_arm64.go", "", False), ("a_darwin_test.go", "", False), ("a_linux_amd64_test.go", "", True), ("windows.go", "", True),
    ("a.go", "//go:build linux && !arm64\n", True), ("a.go", "//go:build windows || (darwin && cgo)\n", False), ("a.go", "//go:build ignore\n", False), ("a.go", "//go:build !windows\n", True), ("a.go", "//go:build go1.21 && unix\n", True),
])
def test_go_default_build(path, head, built):
    from loomgraph.sources.services import go_default_build

    assert go_default_build(path, head + "\npackage x\n\n//go:build never\n") is built


def test_languages(spark):
    table = {
        "a.rb": ("", "Ruby"), "x/Dockerfile": ("", "Dockerfile"), "run": ("#!/usr/bin/env python3.11\n", "Python"), "tool": ("#!/bin/sh\n", "Shell"), "a.h": ("int x;\n", "C"), "b.h": ("namespace n {\n}\n", "C++"),
        "c.h": ("@interface A\n", "Objective-C"), "a.unknown": ("", "unknown"), "A.TSX": ("", "TypeScript"),
    }
    rows = spark.createDataFrame([(p, c) for p, (c, _) in table.items()], "path string, content string")
    assert {r.path: r.language for r in code.with_language(rows).collect()} == {p: language for p, (_, language) in table.items()}
    assert len(code.EXTENSIONS) >= 77


def test_shingle_hashes_and_parts(spark):
    import random
    import re

    import numpy as np

    rng = random.Random(5)
    texts = [None, "", "one two", "Ab, cd! é-f GH 12x"] + [" ".join(rng.choice(["Foo", "bar", "x1", "é", "ü-z", "Q"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    for text, (hashes,) in zip(texts, similarity.gram_hashes(texts, similarity.FNV)):
        terms = re.findall("[a-z0-9]+", (text or "").replace("É", "-").lower())
        assert hashes.tolist() == [similarity.fnv1a(" ".join(terms[i : i + 3]).encode()) for i in range(len(terms) - 2)]
    parts, draw = similarity.Parts(0.82), np.random.default_rng(3)
    for n in (8, 9, 11, 30, 100, 700):
        for _ in range(20):
            a = draw.integers(0, 1 << 63, n).astype(np.uint64)
            gone = draw.integers(0, int(n * 0.18) + 1)
            b = np.r_[a[gone:], draw.integers(0, 1 << 63, max(0, int((n - gone) / 0.82 + 1e-9) - n)).astype(np.uint64)]
            if len(b) < 8 or n - gone < 0.82 * len(np.union1d(a, b)):
                continue
            x, y = ({k: (role, least) for role, least, keys in parts.postings(np.unique(s)) for k in keys.tolist()} for s in (a, b))
            met = [max(x[k][1], y[k][1]) for k in x.keys() & y.keys() if x[k][0] + y[k][0] < 2]
            assert met and len(met) >= max(met)


def test_common_passage_makes_no_candidates(spark, monkeypatch):
    own = iter(f"w{i}" for i in range(10**6))
    note = [f"license{i}" for i in range(60)]
    texts = [[next(own) for _ in range(40)] + note for _ in range(150)] + [note]
    texts += [texts[0][1:], texts[3] + ["more", "words"], texts[5]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    checked, known = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, label: (out := known(df, label), checked.append(out.count()) if label == "met" else 0)[0])
    found = {(r.left, r.right): r.jaccard for r in similarity.exact_pairs(docs).collect()}
    assert set(found) == {(0, 151), (3, 152)} and found[0, 151] == round(97 / 98, 4)
    assert checked and checked[0] < 150  # of 11,175 pairs that share the passage
