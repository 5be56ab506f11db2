"""Session helpers: shared scratch tables, package shipping, and skew-safe building blocks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: dict[int, tuple[SparkSession, list[str]]] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark), (spark, []))[1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _write(df, path, partition_by)
    read = spark.read.schema(df.schema).parquet(path)
    # Spark deletes the write's shuffle files once the JVM sees that nothing holds its plan, which the scheduler does until the next job
    spark.read.schema("x int").parquet(path).limit(0).count()
    spark.sparkContext._jvm.System.gc()
    read._loom_path = path
    return read


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_loom_path", None)
    if path:
        remove_path(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, paths in _WRITTEN.values():
        try:
            if spark.sparkContext._jsc is not None:
                for path in paths:
                    remove_path(spark, path)
        except Exception:  # the JVM may be gone already  # noqa: BLE001
            return


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="loomgraph-zip-"), "loomgraph_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def unbroadcast(df: DataFrame) -> DataFrame:
    """df for a join that sorts and merges: rows that grow with the input compress so well that Spark would send them through the driver."""
    return df.hint("merge")


PART_BYTES = 8_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of the keys in as many parts as its size asks for, so what a task holds of them doesn't grow with the input.

    For keys that hardly repeat: an aggregation before the shuffle would hold all of a task's rows and spare none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART_BYTES), 20_000)), *keys)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever columns the caller added."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, salted_by=None) -> DataFrame:
    """Dense 0-based position `out` of each row within `keys`, without one task ever holding a whole key.

    Rows of a key are spread over salted parts (`salted_by`, or 1024 by a hash of `order`, whatever the cluster); each part is
    numbered alone and shifted by the sizes of the parts before it. The position is a total, repeatable order: (salt, order)."""
    salt, n, base = "__salt", "__n", "__base"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(1024)) if salted_by is None else salted_by)
    inside = salted.withColumn(out, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)).cast("long") - 1)
    sizes = salted.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, salt]]
    joined = inside.alias("l").join(starts.alias("r"), on=_all(same))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{out}") + F.col(f"r.{base}")).alias(out))


def _all(conditions):
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found


HEAVY_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, whose keys are unique, when some keys may hold a large share of left's rows.

    `weight` is right's count of left rows for a key and `total` left's number of rows. Keys with more than
    1/HEAVY_SHARE of them, at most HEAVY_SHARE keys whatever the data, are joined by broadcast and never shuffled; the
    others by a shuffle on the keys."""
    hot = right.filter(F.col(weight) * HEAVY_SHARE > total)
    cold = right.filter(F.col(weight) * HEAVY_SHARE <= total)
    rest = [c for c in right.columns if c not in keys]
    tag = [f"__hot_{c}" for c in right.columns]
    tagged = left.join(F.broadcast(hot.toDF(*tag)), _all([F.col(k) == F.col(f"__hot_{k}") for k in keys]), "left")
    there = F.col(f"__hot_{keys[0]}").isNotNull()
    inside = tagged.filter(there).select(*left.columns, *[F.col(f"__hot_{c}").alias(c) for c in rest])
    outside = tagged.filter(~there).select(*left.columns).join(cold, keys, how).select(*left.columns, *rest)
    return inside.unionByName(outside)
