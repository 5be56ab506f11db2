"""Snapshots: newline-delimited JSON per table with a one-row header and summary, and a Parquet cache keyed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import scratch_path
from loomgraph.sources import code

SCHEMA_VERSION = "1.1"
RELATION = "from_id string, to_id string, type string, confidence double, resolution string, target_kind string"
PROFILES = {
    "full": None,
    "fast": ["DEFINES", "CONTAINS", "IMPORTS", "CALLS", "HANDLES_ROUTE", "HANDLES_TOOL", "RESOURCE_DEPENDS_ON"],
    "syntax-only": ["DEFINES", "CONTAINS"],
}


def with_profile(relations: DataFrame, profile: str) -> DataFrame:
    """The relation types of a profile; `fast` keeps only exactly resolved calls."""
    kept = PROFILES[profile]
    if kept is None:
        return relations
    out = relations.filter(F.col("type").isin(kept))
    return out.filter((F.col("type") != "CALLS") | (F.col("resolution") == "exact")) if profile == "fast" else out


def key(files: DataFrame, profile: str = "full") -> str:
    """A content key: equal trees have equal keys whatever their order. The sum of file digests is taken by the executors."""
    each = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "path", "content"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = files.agg(F.coalesce(F.sum(each), F.lit(0)), F.count(F.lit(1))).first()
    return f"{profile}-{n}-{int(total):x}"


def write(files: DataFrame, path: str | None = None, profile: str = "full") -> str:
    spark = files.sparkSession
    path = path or scratch_path(spark, "snapshot")
    relations = with_profile(code.relations(files), profile)
    relations.write.json(f"{path}/relations")
    code.symbols(files).write.json(f"{path}/symbols")
    code.with_language(files).drop("content").write.json(f"{path}/files")
    head = spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(profile).alias("profile"), F.lit(key(files, profile)).alias("tree"))
    head.write.json(f"{path}/header")
    read_relations(spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("relations")).write.json(f"{path}/summary")
    return path


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations under the fixed schema: unknown fields are dropped, an unknown major version is refused."""
    version = spark.read.schema("schema_version string").json(f"{path}/header").first()[0]
    if version.split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"snapshot of schema {version}; this reads {SCHEMA_VERSION}")
    return spark.read.schema(RELATION).json(f"{path}/relations")


def cached_relations(files: DataFrame, folder: str, profile: str = "full") -> DataFrame:
    """Relations from the Parquet cache of this content and profile, filled on the first call."""
    spark = files.sparkSession
    path = f"{folder}/{key(files, profile)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        with_profile(code.relations(files), profile).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
