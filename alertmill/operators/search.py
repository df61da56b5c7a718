"""A trigram index of alerts: patterns of three characters or more are looked up, not scanned for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators import views
from alertmill.sources.shared import written

#: Columns that a pattern is looked for in, and how each one's value is held against it.
FIELDS = ["title", "alert_id", "user", "host", "src_ip", "alert_type"]
#: Folders of each index table, by a hash of the gram or the value.
BUCKETS = 64
_GRAM = 3


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    """The distinct grams of a text, none if it is shorter."""
    n = F.char_length(text) - (_GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(_GRAM))))).otherwise(F.array().cast("array<string>"))


def _holds(value: Column, q: str) -> Column:
    """Whether a field's value matches, as views.search_alerts() has it."""
    return F.when(F.col("field") == "src_ip", value.startswith(q)).when(F.col("field") == "alert_id", value.contains(q.upper())).otherwise(F.lower(value).contains(q.lower()))


def write_index(alerts: DataFrame, root: str) -> None:
    """Two tables: grams (gram, field, value: each distinct value under its grams) and places (field, value, day, pos).

    Both are dealt into folders by hash and sorted inside, so a look-up opens the folders of its grams or
    values and skips row groups in them. Texts of a field are few beside alerts, except ids, which are short.
    """
    n = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in FIELDS]))
    places = written(alerts.select("pos", F.to_date("ts").alias("day"), F.inline(each)), "search-places")
    # rows of one value go to several tasks: a type or user may be in a third of all alerts
    spread = places.withColumn("bucket", _bucket(F.col("value"))).repartition(n, "bucket", F.pmod(F.xxhash64("pos"), F.lit(n)))
    spread.sortWithinPartitions("bucket", "field", "value").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/places")
    grams = places.select("field", "value").distinct().select("field", "value", F.explode(_grams(F.lower("value"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    grams.repartition(n, "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/grams")


def _buckets_of(spark: SparkSession, values: list[str]) -> list[int]:
    return sorted({r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(_bucket(F.col("v"))).collect()})


def matching_values(spark: SparkSession, root: str, q: str) -> DataFrame:
    """field, value: all values that match a pattern of three characters or more. Values that hold all its grams are checked in full."""
    low = q.lower()
    grams = sorted({low[i : i + _GRAM] for i in range(len(low) - _GRAM + 1)})
    held = spark.read.schema("gram string, field string, value string, bucket int").parquet(f"{root}/grams").filter(F.col("bucket").isin(_buckets_of(spark, grams)) & F.col("gram").isin(grams))
    return held.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == len(grams)) & _holds(F.col("value"), q)).select("field", "value")


def found_places(spark: SparkSession, root: str, q: str) -> DataFrame:
    """day, pos of all alerts that match, once each."""
    values = written(matching_values(spark, root, q).withColumn("bucket", _bucket(F.col("value"))), "search-values")
    buckets = [r[0] for r in values.select("bucket").distinct().collect()]  # 64 at most
    places = spark.read.schema("pos long, day date, field string, value string, bucket int").parquet(f"{root}/places").filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return places.join(values.select("field", "value"), ["field", "value"], "left_semi").select("day", "pos").distinct()


def search(alerts: DataFrame, root: str, q: str, **facets: str | None) -> DataFrame:
    """views.search_alerts() through the index in root; alerts may be partitioned by day, and then only days with a match are read. Shorter patterns are scanned for."""
    if len(q) < _GRAM:
        return views.search_alerts(alerts, q, **facets)
    places = written(found_places(alerts.sparkSession, root, q), "search-found")
    if "day" in alerts.columns:
        days = [r[0] for r in places.select("day").distinct().collect()]  # one row a day
        alerts = alerts.filter(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False)))
    return views.search_alerts(alerts.join(places.select("pos"), "pos", "left_semi"), None, **facets)
