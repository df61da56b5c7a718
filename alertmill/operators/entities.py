"""Entities of alerts and how rare they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_US = 30 * 60 * 1_000_000
FIELDS = [("user", "user", "actor"), ("host", "host", "device"), ("src_ip", "ip", "source"), ("dst_ip", "ip", "destination"), ("process", "process", "process"), ("resource", "resource", "target")]


def entity_links(alerts: DataFrame, *more: str) -> DataFrame:
    """One row for each alert, entity and role: alert_id, pos, us, more columns of alerts, entity_key, type, value, role."""
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(t).alias("type"), F.col(c).alias("value"), F.lit(r).alias("role"))) for c, t, r in FIELDS]))
    out = alerts.select("alert_id", "pos", "us", *more, F.explode(each).alias("e"))
    return out.select("alert_id", "pos", "us", *more, F.concat_ws(":", "e.type", "e.value").alias("entity_key"), "e.type", "e.value", "e.role")


def entity_stats(alerts: DataFrame) -> DataFrame:
    """entity_key, type, value, n_alerts, n_buckets, first_us, last_us, weight.

    Two steps with partial sums (key and bucket, then key), so a key that is in every alert is no one task's
    burden. The weight is the mean of how rare a key is among alerts and among half-hour buckets, from 0 (in
    all of them) to 1.
    """
    corpus = alerts.agg(F.count(F.lit(1)).alias("all_alerts"), F.min("us").alias("start"), F.max("us").alias("end"))
    one_each = alerts.select("us", F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:"), F.col(c))) for c, t, _ in FIELDS])))).alias("entity_key"))
    start = F.broadcast(corpus.select("start"))  # one row
    by_bucket = one_each.crossJoin(start).groupBy("entity_key", F.expr(f"(us - start) div {BUCKET_US}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    stats = by_bucket.groupBy("entity_key").agg(F.sum("n").alias("n_alerts"), F.count(F.lit(1)).alias("n_buckets"), F.min("a").alias("first_us"), F.max("b").alias("last_us"))
    buckets = one_each.select("us").crossJoin(start).agg(F.greatest(F.lit(1), F.count_distinct(F.expr(f"(us - start) div {BUCKET_US}"))).alias("all_buckets"))
    out = stats.crossJoin(F.broadcast(corpus.select("all_alerts"))).crossJoin(F.broadcast(buckets))
    rare = lambda all_, n: F.log((F.col(all_) + 1) / (F.col(n) + 1)) / F.log(F.col(all_) + F.lit(1.0))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * rare("all_alerts", "n_alerts") + 0.5 * rare("all_buckets", "n_buckets")))
    parts = F.split("entity_key", ":", 2)
    return out.select("entity_key", parts[0].alias("type"), parts[1].alias("value"), "n_alerts", "n_buckets", "first_us", "last_us", weight.alias("weight"))


def entity_dimension(stats: DataFrame, users: DataFrame, hosts: DataFrame, resources: DataFrame) -> DataFrame:
    """Entities with what the contexts say of them: privilege or criticality."""
    known = (
        users.select(F.lit("user").alias("type"), F.col("user").alias("value"), F.col("privilege").cast("int").alias("level"))
        .unionByName(hosts.select(F.lit("host").alias("type"), F.col("host").alias("value"), F.col("criticality").cast("int").alias("level")))
        .unionByName(resources.select(F.lit("resource").alias("type"), F.col("resource").alias("value"), F.col("criticality").cast("int").alias("level")))
    )
    return stats.join(known, ["type", "value"], "left")
