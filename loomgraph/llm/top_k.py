"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Vectors near each other share a cell: the leaves of a ball tree over a bounded sample (SAMPLE_ROWS), down which every vector
goes to the nearer centre. A cell's radius covers all its vectors, however many; cells of more than shard_rows are split by
a hash. A task builds a shard's ball tree in numpy and answers a block of queries: nodes are visited by falling upper bound
q.c + |q| r of the inner product, and a node is skipped for every query whose k-th score so far exceeds the bound. The k-th
score is shared: each query first searches its own cell, then the NEXT cells of the highest bounds that reach its k-th score,
then all others that reach the one it has by then; only those pairs of query and cell are shuffled. Components are
floor(scale * x), x as double.

* Vectors that are null or hold null or non-finite components take no part, nor do those with a null vec_id or no components.
* Vectors of different lengths are never compared. A query's own vec_id is no candidate for it.
* Repeated vec_id: every row is a candidate; several query rows with one vec_id share one list of the k best scores of any of them.
* Ties in score go to the smaller vec_id. Empty table: an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, ship_package

SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 128
SAMPLE_ROWS = 32_768
NEXT = 4


def quantize(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    good = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return table.filter(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class BallTree:
    """Leaves are ranges of one reordered matrix; nodes hold centre and radius. Splits are at the median along the
    direction between two far points, so depth is logarithmic whatever the data."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # centre, radius, first, end, left, right

        def build(first: int, end: int) -> int:
            part = vectors[order[first:end]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append(())
            left = right = -1
            if end - first > leaf and away.max() > 0:
                a = part[away.argmax()]
                b = part[((part - a) ** 2).sum(axis=1).argmax()]
                along = np.argsort(part @ (b - a), kind="stable")
                order[first:end] = order[first:end][along]
                middle = (first + end) // 2
                left, right = build(first, middle), build(middle, end)
            self.nodes[me] = (centre, float(away.max()), first, end, left, right)
            return me

        build(0, len(ids))
        self.vectors, self.ids = vectors[order], ids[order]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (n, k), best first, of candidates scoring at least `floor`; -inf and -1 where there are fewer."""
        n = len(queries)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        length = np.sqrt((queries**2).sum(axis=1))
        kth = floor.astype(float).copy()

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            live = bound >= kth[rows]
            rows = rows[live]
            if not len(rows):
                return
            _, _, first, end, left, right = self.nodes[node]
            if left >= 0:
                bounds = []
                for child in (left, right):
                    centre, radius = self.nodes[child][:2]
                    top = queries[rows] @ centre + length[rows] * radius
                    bounds.append(top + 1e-9 * (1 + np.abs(top) + length[rows] * (radius + np.abs(centre).sum())))
                first_left = bounds[0] >= bounds[1]
                for child, b, now in ((left, bounds[0], first_left), (right, bounds[1], ~first_left), (right, bounds[1], first_left), (left, bounds[0], ~first_left)):
                    visit(child, rows[now], b[now])
                return
            scores = queries[rows] @ self.vectors[first:end].T
            ids = self.ids[first:end]
            scores[ids[None, :] == own[rows][:, None]] = -np.inf
            hit = (scores >= kth[rows][:, None]).any(axis=1)
            rows, scores = rows[hit], scores[hit]
            if not len(rows):
                return
            all_scores = np.hstack([best[rows], scores])
            all_ids = np.hstack([who[rows], np.broadcast_to(ids, scores.shape)])
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])

        visit(0, np.arange(n), np.full(n, np.inf))
        return best, who


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(shard) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    tree = BallTree(_matrix(shard["v"]), shard["vec_id"].to_numpy(np.int64))
    own = queries["query_id"].to_numpy(np.int64)
    best, who = tree.search(_matrix(queries["v"]), own, k, queries["floor"].to_numpy(float))
    rows, cols = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"query_id": own[rows], "vec_id": who[rows, cols], "score": best[rows, cols].astype(np.int64)})


class Cells:
    """The leaves of a ball tree over a sample of the vectors of one length."""

    def __init__(self, sample: np.ndarray, leaf: int):
        nodes = BallTree(sample, np.arange(len(sample)), leaf).nodes
        self.leaves = [i for i, node in enumerate(nodes) if node[4] < 0]
        self.centres = np.stack([nodes[i][0] for i in self.leaves])
        self.number = {node: i for i, node in enumerate(self.leaves)}
        self.children = {i: (node[4], node[5], nodes[node[4]][0], nodes[node[5]][0]) for i, node in enumerate(nodes) if node[4] >= 0}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its centre) of each row of x."""
        cell, todo = np.empty(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.number:
                cell[rows] = self.number[node]
                continue
            left, right, a, b = self.children[node]
            nearer = x[rows] @ (b - a) <= (b @ b - a @ a) / 2
            todo += [(left, rows[nearer]), (right, rows[~nearer])]
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))


def placed_in_cells(base: DataFrame, total: int, shard_rows: int) -> tuple[DataFrame, dict[int, Cells]]:
    """base(vec_id, v, dim, spread) with cell and away, its distance from the cell's centre; and the cells by vector length."""
    sample = base.select("v", "dim", F.xxhash64("vec_id", "v", "spread").alias("pick")).orderBy("pick").limit(SAMPLE_ROWS).drop("pick").collect()
    leaf = max(1, len(sample) // max(1, -(-total // shard_rows)))
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(row["v"])
    cells = {dim: Cells(_matrix(rows), leaf) for dim, rows in by_dim.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["cell"], frame["away"] = 0, float("inf")  # a length that no sampled vector has is one cell
            for dim, rows in frame.groupby("dim").indices.items():
                if dim in cells and len(rows):
                    cell, away = cells[dim].place(_matrix(frame["v"].iloc[rows]))
                    frame.iloc[rows, -2], frame.iloc[rows, -1] = cell, away
            yield frame

    return base.mapInPandas(place, "vec_id long, v array<bigint>, dim int, spread long, cell long, away double"), cells


def visits(queries: DataFrame, cells: dict[int, Cells], radius: dict[tuple[int, int], float], first: int, last: int | None) -> DataFrame:
    """queries(query_id, v, dim, spread, home, floor) paired with those of their first to last best other cells whose bound reaches `floor`."""
    there = {dim: np.array(sorted(c for d, c in radius if d == dim), dtype=np.int64) for dim in cells}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, rows in frame.groupby("dim").indices.items():
                if dim not in cells or len(there[dim]) < 2:
                    continue
                part, known = frame.iloc[rows], there[dim]
                centre, reach = cells[dim].centres[known], np.array([radius[dim, c] for c in known])
                for lo in range(0, len(part), 1024):
                    block = part.iloc[lo : lo + 1024]
                    q = _matrix(block["v"])
                    length = np.sqrt((q**2).sum(axis=1))[:, None]
                    top = q @ centre.T + length * reach
                    top += 1e-9 * (1 + np.abs(top) + length * (reach + np.abs(centre).sum(axis=1)))
                    top[known[None, :] == block["home"].to_numpy()[:, None]] = -np.inf
                    order = np.argsort(-top, axis=1, kind="stable")[:, first:last]
                    bound = np.take_along_axis(top, order, 1)
                    i, j = np.nonzero((bound >= block["floor"].to_numpy()[:, None]) & (bound > -np.inf))
                    out = block.iloc[i].copy()
                    out["cell"] = known[order[i, j]]
                    yield out

    return queries.mapInPandas(run, "query_id long, v array<bigint>, dim int, spread long, home long, floor double, cell long")


def top_k(vectors: DataFrame, query_rows, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, v) that the condition `query_rows` names.

    A task holds one shard (about shard_rows vectors) and one block of queries (about block_rows), both bounded by the
    parameters. The driver holds the sample and a radius for each cell, at most SAMPLE_ROWS of both. Scores must be
    exact in a double: |v|^2 below 2^53."""
    spark = vectors.sparkSession
    ship_package(spark)
    base = materialize(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("spread")), "vectors")
    total = base.count()
    placed, cells = placed_in_cells(base, total, shard_rows)
    placed = materialize(placed, "topk-cells")
    known = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = {(r["dim"], r["cell"]): r["radius"] for r in known}
    shape = "s_dim int, s_cell long, parts int, blocks int"
    asked = placed.filter(query_rows).select(F.col("vec_id").alias("query_id"), "v", "dim", "spread", F.col("cell").alias("home"), F.lit(float("-inf")).alias("floor"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    def visited(pairs: DataFrame) -> DataFrame:
        """The k best of each query in each shard of the cell it is paired with."""
        hits = {(r["dim"], r["cell"]): r["n"] for r in pairs.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = [(r["dim"], r["cell"], -(-r["n"] // shard_rows), -(-hits[r["dim"], r["cell"]] // block_rows)) for r in known if (r["dim"], r["cell"]) in hits]
        sizes = F.broadcast(spark.createDataFrame(sizes, shape))  # at most a row for each cell
        on = (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        shards = placed.join(sizes, on).withColumn("part", F.pmod(F.xxhash64("spread"), "parts")).withColumn("block", spread("blocks"))
        blocks = pairs.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("spread", F.lit(7)), "blocks").cast("int")).withColumn("part", spread("parts").cast("long"))
        key = ["dim", "cell", "part", "block"]
        found = shards.select("vec_id", "v", *key).groupBy(*key).cogroup(blocks.select("query_id", "v", "floor", *key).groupBy(*key))
        return materialize(found.applyInPandas(run, "query_id long, vec_id long, score long"), "topk-found")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = visited(asked.withColumn("cell", F.col("home")))
    if len(known) > 1:
        for first, last in ((0, NEXT), (NEXT, None)):
            kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
            floors = asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", "floor")).select(*asked.columns)
            pairs = materialize(visits(floors, cells, radius, first, last), "topk-visits")
            found = found.unionByName(visited(pairs))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (n, k), best first, of candidates scoring at least `floor`; -inf and -1 where there are fewer."""
        n = len(queries)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        length = np.sqrt((queries**2).sum(axis=1))
        kth = floor.astype(float).copy()

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            live = bound >= kth[rows]
            rows = rows[live]
            if not len(rows):
                return
            _, _, first, end, left, right = self.nodes[node]
            if left >= 0:
                bounds = []
                for child in (left, right):
                    centre, radius = self.nodes[child][:2]
                    top = queries[rows] @ centre + length[rows] * radius
                    bounds.append(top + 1e-9 * (1 + np.abs(top) + length[rows] * (radius + np.abs(centre).sum())))
                first_left = bounds[0] >= bounds[1]
                for child, b, now in ((left, bounds[0], first_left), (right, bounds[1], ~first_left), (right, bounds[1], first_left), (left, bounds[0], ~first_left)):
                    visit(child, rows[now], b[now])
                return
            scores = queries[rows] @ self.vectors[first:end].T
            ids = self.ids[first:end]
            scores[ids[None, :] == own[rows][:, None]] = -np.inf
            hit = (scores >= kth[rows][:, None]).any(axis=1)
            rows, scores = rows[hit], scores[hit]
            if not len(rows):
                return
            all_scores = np.hstack([best[rows], scores])
            all_ids = np.hstack([who[rows], np.broadcast_to(ids, scores.shape)])
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])

        visit(0, np.arange(n), np.full(n, np.inf))
        return best, who


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(shard) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    tree = BallTree(_matrix(shard["v"]), shard["vec_id"].to_numpy(np.int64))
    own = queries["query_id"].to_numpy(np.int64)
    best, who = tree.search(_matrix(queries["v"]), own, k, queries["floor"].to_numpy(float))
    rows, cols = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"query_id": own[rows], "vec_id": who[rows, cols], "score": best[rows, cols].astype(np.int64)})


def top_k(vectors: DataFrame, query_rows, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, v) that the condition `query_rows` names.

    A task holds one shard (about shard_rows vectors) and one block of queries (about block_rows), both bounded by
    the parameters. Pairs of shard and block are the tasks of the second round; their number is what an exact search of a
    query set against all rows needs. Scores must be exact in a double: |v|^2 below 2^53."""
    spark = vectors.sparkSession
    ship_package(spark)
    base = materialize(vectors.withColumn("dim", F.size("v")), "vectors")
    total, asked = base.agg(F.count(F.lit(1)), F.count_if(query_rows)).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))
    placed = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = placed.filter(query_rows).select(F.col("vec_id").alias("query_id"), "v", "dim", "shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    schema = "query_id long, vec_id long, score long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    home = placed.groupBy("dim", "shard").cogroup(queries.withColumn("floor", F.lit(float("-inf"))).groupBy("dim", "shard"))
    first = materialize(home.applyInPandas(run, schema), "topk-home")
    if shards == 1:
        found = first
    else:
        kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        floors = queries.join(kth, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf"))))
        floors = materialize(floors, "topk-floors")
        other = floors.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("to") != F.col("shard"))
        there = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = there.groupBy("dim", "shard", "block").cogroup(other.select("query_id", "v", "dim", F.col("to").alias("shard"), "block", "floor").groupBy("dim", "shard", "block"))
        found = first.unionByName(pairs.applyInPandas(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best of all other rows for each row of (vec_id, embedding) whose vec_id is divisible by `every`."""
    return top_k(quantize(table), F.col("vec_id") % every == 0, k)
