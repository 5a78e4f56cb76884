"""Exact deduplication against a persistent digest index (operator 4).

The index is a catalog table bucketed and sorted by digest: one row per distinct normalised text ever accepted, with the
document that holds it and the batch that brought it.  A batch of new documents is reduced to its distinct digests
(map-side combined), sort-merge anti-joined against the index and what is left is appended; what stays is then read off
the index.  Only ids and 32-byte digests are ever shuffled, never texts, and the index itself is read by bucket without
a shuffle.  ``exact_dedup`` deals a table to one index in batches of descending doc_id, so that the largest doc_id of
equal texts comes first.

Defined results: a null text counts as empty; empty texts are copies of each other; only A-Z are lower-cased; of equal
texts in one batch the largest doc_id stays, a null doc_id only if the group has no other; texts that the index already
holds from an earlier batch are dropped in favour of the earlier document, which itself stays if it comes again; a batch
added again (a retry, at any point) changes neither the index nor its own result; of rows repeating both doc_id and text
exactly one stays; an empty batch gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.llm.common import attach, broadcast_if_small, free_names, lower_ascii, one_of_each, stage

BUCKETS = 64


def digest_of(text):
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): the distinct pairs, counted before they are shuffled."""
    return docs.select(digest_of(F.col("text")).alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


class DigestIndex:
    """A table (digest, keep_id, batch) bucketed and sorted by digest that grows batch by batch.

    Every append adds one sorted file per bucket; Spark reads the buckets without a shuffle.  ``buckets`` should follow
    the size the index is meant to reach (about 128 MB a bucket).  With ``path`` the table outlives the catalog: a later
    session that names the same path goes on with it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, path: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        where = f" LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id) of the texts of ``rows`` (as ``digests`` gives them) that the index lacks."""
        return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id")).hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Accept what is new.  The append is one job, so it is there whole or not at all; after it nothing is new."""
        new = self.fresh(rows).select("digest", "keep_id", F.lit(batch).alias("batch"))
        # each bucket is written by one task, whatever the number of partitions comes to, so an append adds a file a bucket
        new.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))).write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def judge(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """One row per document of ``rows``, all of whose texts the index holds: doc_id, keep_id, group_size (within
        ``rows``), kept, text_sha256, in_index (a batch other than ``batches`` brought the text)."""
        groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.count("*").alias("held"))
        held = self.read().select("digest", "keep_id", (~F.col("batch").isin(batches)).alias("in_index"))
        groups, _ = stage(groups.hint("merge").join(held, "digest"), "groups")
        out = attach(rows, groups, "digest", "held", rows.count())
        stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
        return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
            "doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_index")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against the index and itself; the same batch has the same name, by default a checksum."""
        rows, _ = stage(digests(docs), "digests")
        batch = batch or seal(rows)
        self.append(rows, batch)
        return self.judge(rows, [batch])


def seal(rows: DataFrame) -> str:
    """An order-free checksum of a batch."""
    mixed = F.xxhash64("digest", "doc_id", "copies")
    return "-".join(map(str, rows.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)")), F.bit_xor(mixed)).first()))


def exact_dedup(docs: DataFrame, table: str | None = None, batches: int = 2) -> DataFrame:
    """Deduplicate ``docs`` through the index ``table``, in ``batches`` of descending doc_id; without a name, through one
    that is dropped when the result is staged."""
    spark = docs.sparkSession
    rows, _ = stage(digests(docs), "digests")
    index = DigestIndex(spark, table or f"lodestead_digests_{uuid.uuid4().hex}")
    name = seal(rows)
    # where a batch begins is not part of the result: any descending cuts give the same
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or ()), reverse=True)
    above = [F.col("doc_id") >= c for c in cuts]
    parts = [*above[:1], *(above[i] & ~above[i - 1] for i in range(1, len(cuts))), ~F.coalesce(above[-1], F.lit(False)) if cuts else F.lit(True)]
    names = [f"{name}-{i}" for i in range(len(parts))]
    for batch, part in zip(names, parts):
        index.append(rows.where(part), batch)
    out = index.judge(rows, names)
    if not table:
        out, _ = stage(out, "judged")
        spark.sql(f"DROP TABLE {index.table}")
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, less those that exact_dedup drops.

    Copies are few and narrow (doc_id, digest), so the texts move only if the list of copies is too long to broadcast.
    Of rows that repeat doc_id and text but differ elsewhere, the first by a hash of the whole row stays.  Nulls, empty
    tables and columns of any name are as defined for the module; an added column's name gives way to the table's own.
    """
    judged = exact_dedup(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("digest"))
    # a pair (doc_id, digest) with a kept row stays; its repeats are equal in both and one is chosen below
    gone = judged.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    gone, _ = stage(gone.where("not stays or n > 1"), "gone")
    lost, again = gone.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    mark, of, gone_id = free_names(docs, "digest_of_row", "digest_of_gone", "id_of_gone")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(of), F.col("stays").alias(f"{of}_stays"))
    if not lost and not again:
        return docs
    marked = docs.withColumn(mark, digest_of(F.col("text")))
    same = (F.col(mark) == F.col(of)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_id))
    left = marked.join(broadcast_if_small(gone, lost + again, 64), same, "left_anti").drop(mark)
    if not again:
        return left
    twice = marked.join(broadcast_if_small(gone.where(f"{of}_stays"), again, 64), same, "left_semi")
    return left.unionByName(one_of_each(twice, ["doc_id", mark], docs.columns))
