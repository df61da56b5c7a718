"""Writing, merging, exporting and purging result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from alertmill.sources.shared import written

TABLES = [
    "ingest_batches", "alerts", "entities", "alert_entities", "pipeline_runs", "incidents", "incident_alerts", "incident_entities", "attack_stages", "incident_mitre",
    "decision_runs", "llm_runs", "analyst_feedback", "audit_events", "evaluation_runs", "triage_trials",
]
CACHES = ["decision_runs", "llm_runs"]


def append(df: DataFrame, root: str, name: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(f"{root}/{name}")


def replace(df: DataFrame, root: str, name: str) -> None:
    """A full refresh; df must not read the table that it replaces."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def exists(spark: SparkSession, root: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def replace_days(df: DataFrame, root: str, name: str, day: str = "day") -> None:
    """Replaces the days that df has; the files of all other days stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{root}/{name}")


def merge_days(spark: SparkSession, root: str, name: str, changes: DataFrame, keys: list[str], values: dict[str, Column], number: int, day: str = "day") -> list:
    """Sets columns of the stored rows that changes name, in the days that changes touch; gives these days.

    changes: day, keys (once each) and columns of its own; values: stored columns and what they become, from stored columns and those of changes,
    which are called new_. Only the touched days are read and written again, as new files that take the old ones' place
    together. Each row keeps the number of the last merge that changed it, so a merge that is run again after a failure
    changes no row twice; numbers must rise. A row without a day is in a day of its own (null).
    """
    days = [r[0] for r in changes.select(day).distinct().collect()]  # one row a day
    if not days:
        return []
    known = [d for d in days if d is not None]
    touched = F.col(day).isin(known) if known else F.lit(False)
    schema = read(spark, root, name).schema
    if "merged_by" not in schema.names:  # files of merges have it, others read as null
        schema = StructType([StructField("merged_by", LongType()), *schema.fields])
    stored = spark.read.schema(schema).parquet(f"{root}/{name}").filter(touched | F.col(day).isNull() if None in days else touched)
    columns = [c for c in stored.columns if c != "merged_by"]
    last = F.coalesce(F.col("merged_by"), F.lit(-1))
    new = changes.select(*[F.col(c).alias(f"new_{c}") for c in changes.columns])
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"new_{k}") for k in keys] + [F.col(day).eqNullSafe(F.col(f"new_{day}"))])
    both = stored.join(new, on, "left").withColumn("_hit", F.col(f"new_{keys[0]}").isNotNull() & (last < number))
    out = [F.when(F.col("_hit"), values[c].cast(stored.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns]
    out.append(F.when(F.col("_hit"), F.lit(number).cast("long")).otherwise(F.when(last >= 0, last.cast("long"))).alias("merged_by"))
    replace_days(written(both.select(*out), "merged-days"), root, name, day)
    return days


def raise_duplicates(spark: SparkSession, root: str, rows: DataFrame, number: int, name: str = "alerts") -> list:
    """Adds a batch's duplicates (rows of ingest.classified() with duplicate_of) to the counters of the stored alerts that they repeat.

    A duplicate has the content of its alert and so its time: the day is the row's own. Where it repeats an id alone, the
    day comes from a scan of ids and days.
    """
    more = rows.filter("status = 'duplicate' and duplicate_of is not null").groupBy(F.col("duplicate_of").alias("alert_id"), F.to_date("ts").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    more = written(more, "more-duplicates")
    at = read(spark, root, name).select(F.col("alert_id").alias("_id"), "day")
    near = at.join(F.broadcast(more.select(F.col("own").alias("day")).distinct()), "day", "left_semi")  # a row a day
    found = written(more.join(near, F.col("alert_id") == F.col("_id")).select("alert_id", "own", "day", "n"), "near-duplicates")
    other = more.join(found.select("alert_id", "own"), ["alert_id", "own"], "left_anti")
    if not other.isEmpty():
        found = found.unionByName(other.join(at, F.col("alert_id") == F.col("_id")).select("alert_id", "own", "day", "n"))
    changes = written(found.groupBy("alert_id", "day").agg(F.sum("n").alias("n")), "duplicate-changes")
    return merge_days(spark, root, name, changes, ["alert_id"], {"duplicate_count": F.col("duplicate_count") + F.col("new_n")}, number)


def append_gaps(spark: SparkSession, root: str, name: str, incoming: DataFrame, keys: list[str], only_ok: bool = False) -> None:
    """Appends the rows of fill_gaps() that the stored table lacks; its files stay, and only its keys are read. Doing it again adds nothing."""
    have = read(spark, root, name)
    have = (have.filter("status = 'ok'") if only_ok else have).select(*keys).distinct()
    new = incoming.dropDuplicates(keys).join(have, keys, "left_anti")
    append(written(new, "gaps"), root, name)


def append_alerts(alerts: DataFrame, root: str) -> None:
    append(alerts.withColumn("day", F.to_date("ts")), root, "alerts", by="day")


def purge(spark: SparkSession, root: str, with_caches: bool = False) -> None:
    """Empties the tables that are there; the two caches keyed by evidence stay unless asked."""
    for name in TABLES:
        if name in CACHES and not with_caches:
            continue
        try:
            schema = read(spark, root, name).schema
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        replace(spark.createDataFrame([], schema), root, name)


def with_results(alerts: DataFrame, memberships: DataFrame, scores: DataFrame) -> DataFrame:
    """alerts with incident_id, rule_score and anomaly_score."""
    return alerts.join(memberships.select("alert_id", "incident_id"), "alert_id", "left").join(scores.select("alert_id", "rule_score", "anomaly_score"), "alert_id", "left")


def alert_entity_links(links: DataFrame) -> DataFrame:
    return links.select("alert_id", "entity_key", "role").distinct()


def newest(rows: DataFrame, time: str, n: int) -> DataFrame:
    """The n newest rows, 1000 at most."""
    return rows.orderBy(F.desc(time), *[F.desc(c) for c in rows.columns if c != time]).limit(min(n, 1000))


def exportable(rows: DataFrame, provider: str | None = None) -> DataFrame:
    """Cached rows that are ok (and, with a provider column, not from a template)."""
    out = rows.filter("status = 'ok'")
    return out.filter(F.col(provider) != "template") if provider else out


def fill_gaps(stored: DataFrame, incoming: DataFrame, keys: list[str], only_ok: bool = False) -> DataFrame:
    """stored and the incoming rows whose keys it lacks (only_ok: whose keys no ok row of it has), each key once. Doing it again adds nothing."""
    have = stored.filter("status = 'ok'") if only_ok else stored
    new = incoming.dropDuplicates(keys).join(have.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def rating_sheet(briefs: DataFrame) -> DataFrame:
    """One row for each claim of the briefs (facts array<string>, hypotheses array<string>) to be rated."""
    facts = briefs.select("brief_id", "provider", F.lit("fact").alias("kind"), F.explode("facts").alias("claim"))
    return facts.unionByName(briefs.select("brief_id", "provider", F.lit("hypothesis").alias("kind"), F.explode("hypotheses").alias("claim"))).withColumn("rating", F.lit(None).cast("string"))
