"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty.

* Empty table: an empty result with the same columns.
* Null doc_id: sorts below every number, so such a row stays only where no numbered row has its text; keep_id is then null.
* Repeated rows: exactly one row of a group stays, also where doc_id repeats.
* Further columns, whatever their names, are carried by `deduplicate` and ignored by `digest_groups`.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import free_name, materialize, scratch_path, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_SHARE = 1000  # a digest with more than 1/1000 of all rows is hot; there are at most 1000 of these


def digest_of(text):
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


class DigestIndex:
    """Every digest seen so far, as an external table of `buckets` hash buckets, sorted by digest within a bucket.

    Entries carry the name of the batch that brought them. A batch doesn't count its own entries as known and appends only those
    that are missing, so a batch whose result was lost can be run again under its name and gives the same answer.
    The bucketing lets the anti-join of a new batch read the index without shuffling or sorting it when a bucket has
    one file; after appends Spark sorts the (already co-located) buckets. `buckets` is fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digest-index")
        self.table = "digest_index_" + re.sub(r"\W", "_", uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex)
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

        if path is None:  # a scratch index leaves no entry in the catalogue
            atexit.register(self._forget)

    def _forget(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of digests(digest, ...) that no other batch brought: a sort-merge anti-join on the bucketed key."""
        known = self.read() if batch is None else self.read().filter(F.col("batch") != batch)
        return digests.hint("merge").join(known.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add those of groups(digest, keep_id, group_size) that are missing; one task writes each bucket, a file for each append."""
        (
            self.unseen(groups).select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of rows(doc_id, row_no, digest); partial aggregation absorbs hot digests."""
    best = F.max(F.struct("doc_id", "row_no"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "group_size"
    )


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    `known` is true where another batch brought the digest before; then no row of this one is kept. The new groups are appended
    to the index under the name `batch`; a run that names its batch can be repeated (see DigestIndex). Only digests and ids are shuffled, never text. A digest with more than
    1/1000 of the rows (at most 1000 of them) is joined by broadcast, all others by a shuffle on the digest."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = materialize(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.unhex(digest_of(F.col("text"))).alias("digest")),
        "digests",
    )
    groups = materialize(digest_groups(rows), "digest-groups")
    batch = batch or uuid.uuid4().hex
    fresh = materialize(index.unseen(groups, batch), "digest-fresh")
    index.append(fresh, batch)
    marked = groups.join(fresh.select("digest", F.lit(True).alias("fresh")), "digest", "left")
    total = rows.count()
    hot = marked.filter(F.col("group_size") * HEAVY_SHARE > total)
    cold = marked.filter(F.col("group_size") * HEAVY_SHARE <= total)
    named = F.broadcast(hot.select(F.col("digest").alias("hot_digest"), *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "group_size", "fresh")]))
    tagged = rows.join(named, F.col("digest") == F.col("hot_digest"), "left")
    in_hot = tagged.filter(F.col("hot_digest").isNotNull()).select(
        "doc_id", "row_no", "digest", *[F.col(f"hot_{c}").alias(c) for c in ("keep_id", "keep_row", "group_size", "fresh")]
    )
    in_cold = tagged.filter(F.col("hot_digest").isNull()).select("doc_id", "row_no", "digest").join(cold, "digest")
    both = in_hot.unionByName(in_cold.select(in_hot.columns))
    return both.select(
        "doc_id", "keep_id", "group_size",
        (F.coalesce(F.col("fresh"), F.lit(False)) & (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (~F.coalesce(F.col("fresh"), F.lit(False))).alias("known"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without exact copies and without texts the index knows: of each group the row with the largest doc_id.

    One shuffle moves the rows by digest; map-side combining keeps one row a digest and task, so a hot text is reduced
    before the shuffle. Rows that tie on doc_id are ordered by a hash of their text; of rows that tie on both, any one stays."""
    digest = free_name(docs, "digest__")
    whole = docs.withColumn(digest, F.unhex(digest_of(F.col("text"))))
    order = F.struct(F.col("doc_id"), F.xxhash64("text"))
    best = whole.groupBy(digest).agg(
        F.max_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias("row"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    if index is not None:
        batch = batch or uuid.uuid4().hex
        best = materialize(index.unseen(best.withColumnRenamed(digest, "digest"), batch), "dedup-fresh")
        index.append(best, batch)
    return best.select("row.*")


def index_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}"
