"""Operators 4, 5, 7 and 8 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import exact_dedup, mixing, packing, top_k
from loomgraph.llm.queries import tokenizer_path


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 4 ---------------------------------------------------------------------------------------------


def test_exact_duplicates_equal_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = exact_dedup.exact_duplicates(docs).collect()
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r.doc_id, digest[r.text_sha256]) for r in got) == Counter((r[0], lowered(r[1])) for r in rows)
    assert all(r.keep_id == best[digest[r.text_sha256]] and r.group_size == len(groups[digest[r.text_sha256]]) for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(digest.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and Counter(lowered(r.text) for r in kept.collect()) == Counter(groups.keys())


def test_index_persists_between_batches(spark, docs, no_docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = exact_dedup.exact_duplicates(docs, index).filter("kept").count()
    again = exact_dedup.exact_duplicates(docs, exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4))
    assert again.filter("kept").count() == 0 and again.filter("known").count() == docs.count()
    more = spark.createDataFrame([(900, "brand new"), (901, "Brand NEW"), (902, "one")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.exact_duplicates(more, index).filter("kept").collect()] == [901]
    assert index.read().count() == first + 1
    assert exact_dedup.exact_duplicates(no_docs, index).count() == 0
    assert exact_dedup.deduplicate(more, index).count() == 0
    plan = index.unseen(index.read().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # both sides are bucketed


def test_a_named_batch_can_be_run_again(spark, docs, rows, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    old = spark.createDataFrame([(1, "one"), (2, "never seen")], "doc_id long, text string")
    exact_dedup.exact_duplicates(old, index, "first")
    key = lambda: Counter((r.doc_id, r.kept, r.known) for r in exact_dedup.exact_duplicates(docs, index, "second").collect())
    lost, size = key(), index.read().count()
    assert key() == lost and index.read().count() == size  # the result of the first run was lost
    assert not any(kept and known for _, kept, known in lost) and sum(n for (_, kept, _), n in lost.items() if kept) == len({lowered(r[1]) for r in rows}) - 1
    assert exact_dedup.deduplicate(docs, index, "second").count() == len({lowered(r[1]) for r in rows}) - 1
    assert exact_dedup.deduplicate(docs, index, "third").count() == 0


# 5 ---------------------------------------------------------------------------------------------


def brute_targets(size):
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    goal, fixed = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in sources if s not in fixed]
        rest = goal - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * size[s] for s in over}


@pytest.mark.parametrize("table", ["fixture", "sf"])
def test_mixing_follows_the_targets(spark, docs, table):
    docs = docs if table == "fixture" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = defaultdict(int)
    longest = defaultdict(int)
    for r in rows:
        size[r.source] += count(r.text)
        longest[r.source] = max(longest[r.source], count(r.text))
    target = brute_targets(dict(size))
    got = mixing.mix_plan(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, count(r.text)) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in size)
    key = lambda found: Counter((r.doc_id, r.size, r.taken) for r in found)
    assert key(mixing.mix_plan(docs.repartition(3)).collect()) == key(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_keeps_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(i if i else None, "a b " * i, "s", 1, 2, 3, 4, 5) for i in range(20)], "doc_id long, text string, source string, p_id int, p_size int, p_nth int, mix_place int, copies int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.mix_plan(docs).collect())


def test_mixing_equals_its_sql(spark, docs):
    import duckdb

    from loomgraph.llm import queries

    for table in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), docs.limit(0)):
        with duckdb.connect() as db:
            frame = table.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
            db.register("frame", frame)
            db.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM frame")
            expected = db.execute(queries.oracle_sql()["op5_source_mixing"]).fetchall()
        got = mixing.mix_plan(table).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert Counter(map(tuple, got)) == Counter(expected)


def test_mixing_of_nothing(spark, no_docs):
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0]


# 7 ---------------------------------------------------------------------------------------------


def check_packing(pieces, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        at = 0
        for p, end in enumerate(cuts):
            expected[(doc_id, p, at, end - at, zlib.crc32(ids[at:end].tobytes()))] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 96])
def test_packing_round_trip(docs, rows, spark, sf, capacity):
    check_packing(packing.pack(docs, tokenizer_path(), capacity).collect(), [(r[0], r[1]) for r in rows], capacity)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    pieces = packing.pack(table, tokenizer_path(), capacity).collect()
    n = check_packing(pieces, texts, capacity)
    assert n <= 1.02 * -(-sum(r.length for r in pieces) // capacity) + 2


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.randint(5, 60)
        counts = {length: rng.randint(0, 30) for length in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        room = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [i for i, r in enumerate(room) if r >= length]
                if fits:
                    i = min(fits, key=lambda i: room[i])
                    room[i] -= length
                else:
                    room.append(capacity - length)
        used = defaultdict(int)
        ranks = defaultdict(list)
        for length, first_rank, end_rank, first_bin, per, offset in packing.plan_packing(counts, capacity):
            for k in range(end_rank - first_rank):
                b = first_bin + k // per
                assert used[b] == offset + (k % per) * length
                used[b] += length
                ranks[length].append(first_rank + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
        assert sorted(used.values()) == sorted(capacity - r for r in room)


def test_special_token_strings(spark):
    texts = [(1, "a <|endoftext|> b"), (2, "x" * 5000 + " y"), (3, "  \n\n z's 12345 ½ ٣  　 don't 'LL"), (4, "日本語 🙂 é‍")]
    check_packing(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path()).collect(), texts)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path()), random.Random(4)
    pools = ["abcdefgh ", "  \n\t\r\x0b\x85\xa0\u2028", "'sStTrReElLdDvVmM ", "0123½²٣ⅷ", "éñüßíó ", "日本語한", "!?.,;:-_\"'()", "\u0300\u0301\u200d", "🙂🚀", "etaoinshr"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 40))) for _ in range(20000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(2000)]
    texts += [" " * 1_500_000, "\n" * 1_500_000 + "x", "a" * 300_000, "<|endoftext|>", "a<|endoftext|> b"]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == np.array(found.ids, dtype="<u4").tobytes(), text[:50]


def test_other_tokenizer_files_have_no_ranks():
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.merge_ranks(spec)[b" the"] == spec["model"]["vocab"]["Ġthe"]
    spec["normalizer"] = {"type": "Lowercase"}
    assert packing.merge_ranks(spec) is None
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert packing.merge_ranks(json.load(f)) is None


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


# 8 ---------------------------------------------------------------------------------------------


def brute_top(vectors, every, k):
    """The k best of all rows but those of the query's vec_id, over all query rows with one vec_id."""
    scored = defaultdict(list)
    for q, v in vectors:
        if q % every == 0:
            scored[q] += [(-int(v @ w), i) for i, w in vectors if i != q and len(w) == len(v)]
    return Counter((q, n + 1, i, -s) for q, found in scored.items() for n, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(8192, 4096), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows, block_rows):
    rng = np.random.RandomState(2)
    data = [(i, [float(x) for x in np.round(rng.randn(6), 1)]) for i in range(300)]
    data += [(1000 + i, data[i][1]) for i in range(20)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, []), (None, [1.0] * 6), (2250, [1.0] * 5), (2251, [2.0] * 5)]
    data += [data[0], data[50]]
    table = spark.createDataFrame([(*d, 1, "x", 2.0) for d in data], "vec_id long, embedding array<float>, label int, v string, score double")
    good = [(i, np.floor(256 * np.asarray(np.float32(v), dtype=float)).astype(int)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    got = top_k.top_k(top_k.quantize(table), top_k.F.col("vec_id") % 50 == 0, 5, shard_rows, block_rows).collect()
    assert Counter(tuple(r) for r in got) == brute_top(good, 50, 5)


def test_top_k_equals_its_sql_on_repeated_rows(spark):
    import duckdb

    from loomgraph.llm import queries

    rng = np.random.RandomState(3)
    data = [(i, [float(x) for x in rng.randn(4)]) for i in [0, 0, 50, 50, 1, 1, 1, 2, 3, 4, 5, 6]]
    data += [data[0], data[4], (50, [9.0, 9.0, 9.0, 9.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    frame = table.toPandas()
    frame["embedding"] = frame["embedding"].map(list)
    with duckdb.connect() as db:
        db.register("frame", frame)
        db.execute("CREATE TABLE embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM frame")
        expected = db.execute(queries.oracle_sql()["op8_exact_top_k"]).fetchall()
    assert Counter(tuple(r) for r in top_k.search(table).collect()) == Counter(expected)


def test_few_cells_are_visited_on_clustered_vectors(spark):
    rng = np.random.RandomState(4)
    centres = rng.randn(20, 8) * 40
    data = [(i, [float(x) for x in centres[i % 20] + rng.randn(8)]) for i in range(4000)]
    vectors = top_k.quantize(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    placed, cells = top_k.placed_in_cells(vectors.withColumn("dim", top_k.F.size("v")).withColumn("spread", top_k.F.col("vec_id")), 4000, 100)
    placed = placed.cache()
    known = placed.groupBy("dim", "cell").agg(top_k.F.max("away").alias("radius")).collect()
    good = dict((i, np.floor(256 * np.asarray(np.float32(v), dtype=float)).astype(int)) for i, v in data)
    queries = [(i, good[i].tolist(), 8, i, -1, float(np.sort(np.stack(list(good.values())) @ good[i])[-6])) for i in range(0, 4000, 50)]
    table = spark.createDataFrame(queries, "query_id long, v array<bigint>, dim int, spread long, home long, floor double")
    pairs = top_k.visits(table, cells, {(r["dim"], r["cell"]): r["radius"] for r in known}, 0, None).count()
    assert len(known) >= 20 and pairs < 0.2 * len(known) * len(queries)
    placed.unpersist()


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.search(empty).count() == 0
    assert top_k.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
