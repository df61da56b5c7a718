"""Batches of raw alerts split into accepted, duplicate and rejected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(normalized: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of normalize() with status, duplicate_of and duplicate_count.

    In the batch the first row of an alert_id counts and later ones are rejected; rows with errors are
    rejected; the first accepted row of a content hash stays, later ones are its duplicates. known (alert_id,
    content_hash) are alerts already stored: equal ids or hashes are duplicates of those. Both windows are
    over keys with few rows; copies of one alert beyond that are sorted on disk, not held in memory. Rows
    without an id, and rejected ones, are groups of their own in a window, so all rows go one way and are read once.
    """
    rows = normalized.withColumn("_alone", F.when(F.col("alert_id").isNull(), F.col("pos")))
    rows = rows.withColumn("_id_place", F.row_number().over(Window.partitionBy("alert_id", "_alone").orderBy("pos")))
    rows = rows.withColumn("errors", F.when((F.col("_id_place") > 1) & (F.size("errors") == 0), F.array(F.lit("duplicate alert_id"))).otherwise(F.col("errors")))
    good = F.size("errors") == 0
    rows = rows.withColumns({"_good": good, "_hash": F.when(good, F.col("content_hash")), "_alone": F.when(~good, F.col("pos"))})
    whole = Window.partitionBy("_hash", "_alone")
    by_hash = whole.orderBy("pos")
    rows = rows.withColumns({"_place": F.row_number().over(by_hash), "_first": F.first("alert_id").over(by_hash), "_copies": F.count(F.lit(1)).over(whole) - 1})
    if known is None:
        rows = rows.withColumns({"_stored_hash": F.lit(None).cast("string"), "_stored_id": F.lit(None).cast("string")})
    else:
        hashes = known.groupBy("content_hash").agg(F.min("alert_id").alias("_stored_hash"))
        ids = known.select(F.col("alert_id"), F.col("alert_id").alias("_stored_id")).distinct()
        rows = rows.join(hashes, "content_hash", "left").join(ids, "alert_id", "left")
    stored = F.coalesce("_stored_id", "_stored_hash")
    rows = rows.withColumns(
        {
            "status": F.when(~F.col("_good"), "rejected").when(stored.isNotNull() | (F.col("_place") > 1), "duplicate").otherwise("accepted"),
            "duplicate_of": F.when(F.col("_good"), F.coalesce(stored, F.when(F.col("_place") > 1, F.col("_first")))),
            "duplicate_count": F.when(F.col("_good") & stored.isNull() & (F.col("_place") == 1), F.col("_copies")).otherwise(0),
        }
    )
    return rows.select(*normalized.columns, "status", "duplicate_of", "duplicate_count")


def batch_summary(rows: DataFrame) -> DataFrame:
    """received, accepted, duplicates and rejected: one row."""
    return rows.agg(F.count(F.lit(1)).alias("received"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("accepted", "accepted"), ("duplicate", "duplicates"), ("rejected", "rejected"))])


def first_rejects(rows: DataFrame, limit: int = 200) -> DataFrame:
    return rows.filter("status = 'rejected'").select("pos", "alert_id", "errors").orderBy("pos").limit(limit)


def batch_record(rows: DataFrame, batch_id: str, source_name: str | None = None, limit: int = 200) -> DataFrame:
    """One row of the batch log: batch_id, source_name, batch_summary() and rejected_rows, the first limit rejects by pos (pos, alert_id, errors)."""
    first = first_rejects(rows, limit).agg(F.array_sort(F.collect_list(F.struct("pos", "alert_id", "errors"))).alias("rejected_rows"))
    return batch_summary(rows).crossJoin(F.broadcast(first)).select(F.lit(batch_id).alias("batch_id"), F.lit(source_name).cast("string").alias("source_name"), "*")


def bump_duplicates(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored alerts with their duplicate_count raised by a later batch's duplicates of them."""
    more = rows.filter("status = 'duplicate'").groupBy(F.col("duplicate_of").alias("alert_id")).agg(F.count(F.lit(1)).alias("_more"))
    return stored.join(more, "alert_id", "left").withColumn("duplicate_count", F.col("duplicate_count") + F.coalesce("_more", F.lit(0))).select(*stored.columns)
