"""Alerts as a stream: micro-batches through the batch functions, with state in tables.

The drained stream has the alerts of the batch if rows come in the order of pos. (A row with the id of an earlier batch's row counts as a duplicate, while
one batch rejects it.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import normalize
from alertmill.operators import ingest
from alertmill.operators.correlate import Correlation
from alertmill.plans import pipeline
from alertmill.sources import shared, tables

RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def source(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Raw alerts from Parquet files as they arrive, all new files or so many in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def released(raw: DataFrame, until_us: int, after_us: int | None = None) -> DataFrame:
    """The raw rows that arrive by event time after one instant and until another. Rows without a readable time come with the first release (no after_us), to be rejected."""
    t = F.unix_micros(normalize.parse_time(F.col("timestamp").cast("string")))
    if after_us is None:
        return raw.filter(t.isNull() | (t <= until_us))
    return raw.filter((t > after_us) & (t <= until_us))


def _known(spark: SparkSession, root: str, name: str = "stream_alerts") -> DataFrame | None:
    try:
        return tables.read(spark, root, name)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


#: Keyed state on local disk, written to the checkpoint: what is known need not fit into memory.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _only_new(spark: SparkSession, root: str, schema) -> None:
    """Appends those of the batches' candidates whose id and content no earlier batch had to stream_alerts.

    A query of its own over the candidates' files: ids and content hashes are keyed state, which never expires, so a
    run reads the new candidates and their keys' state, not the alerts stored so far. Its checkpoint and the file
    sink make each candidate count once, also after a failure.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        new = spark.readStream.schema(schema).parquet(f"{root}/stream_candidates").dropDuplicates(["alert_id"]).dropDuplicates(["content_hash"])
        query = new.writeStream.partitionBy("batch").option("checkpointLocation", f"{root}/stream_known").trigger(availableNow=True).outputMode("append").start(f"{root}/stream_alerts", format="parquet")
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The accepted alerts of all batches, with their batch."""
    return spark.read.schema(tables.read(spark, root, "stream_candidates").schema).parquet(f"{root}/stream_alerts")


def _done(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ingest_batch(root: str, contexts: tuple | None = None, analyze: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: normalises, classifies the batch in itself, drops what is known by id or content, appends alerts, duplicates and counters.

    A batch costs what its own rows cost, whatever came before (see _only_new). Each batch's rows carry its number. A
    batch that is run again finds its candidates written and counted, so a retry gives the same tables. analyze
    gets all alerts so far.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        users, hosts, resources = contexts or (None, None, None)
        rows = ingest.classified(normalize.normalize(batch, users, hosts, resources)).withColumn("batch", F.lit(number)).persist()
        at = f"{root}/stream_candidates/batch={number}"
        own = rows.filter("status = 'accepted'")
        if not _done(spark, at):
            own.drop("batch").write.mode("overwrite").parquet(at)
        _only_new(spark, root, own.schema)
        kept = stored(spark, root).filter(F.col("batch") == number).select(F.col("alert_id").alias("_id"), F.lit(True).alias("_new"))
        told = rows.join(kept, (F.col("alert_id") == F.col("_id")) & (F.col("status") == "accepted"), "left").drop("_id")
        again = (F.col("status") == "accepted") & F.col("_new").isNull()
        told = told.withColumns({"status": F.when(again, "duplicate").otherwise(F.col("status")), "_earlier": again}).drop("_new").persist()
        for name, part in (("stream_duplicates", told.filter("status = 'duplicate'")), ("stream_rejects", told.filter("status = 'rejected'").drop("_earlier")), ("stream_counters", ingest.batch_summary(told))):
            part.drop("batch").write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        told.unpersist()
        rows.unpersist()
        if analyze:
            analyze(stored(spark, root).drop("batch"), number)

    return run


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs all files that are there as micro-batches and ends."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def duplicates(spark: SparkSession, root: str) -> DataFrame:
    """All duplicates with duplicate_of, the alert of the same content that was stored then, or else the one of the same id; its batch is _first."""
    told = tables.read(spark, root, "stream_duplicates").drop("duplicate_of")
    kept = stored(spark, root).select(F.col("alert_id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("batch").alias("_first"))
    by_hash = told.join(kept.select("_hash", "_first", F.col("_id").alias("duplicate_of")), (F.col("content_hash") == F.col("_hash")) & (F.col("_first") <= F.col("batch")), "left").drop("_hash")
    by_id = by_hash.filter("duplicate_of is null").drop("duplicate_of", "_first").join(kept.select("_first", F.col("_id").alias("duplicate_of")), F.col("alert_id") == F.col("duplicate_of"), "left")
    return by_hash.filter("duplicate_of is not null").unionByName(by_id)


def drained(spark: SparkSession, root: str) -> DataFrame:
    """All accepted alerts; duplicates that came in later batches raise the counters of what they repeat."""
    alerts = stored(spark, root)
    return ingest.bump_duplicates(alerts.drop("batch"), duplicates(spark, root).filter("batch <> _first"))


def counters(spark: SparkSession, root: str) -> DataFrame:
    """One row of sums over all batches."""
    return tables.read(spark, root, "stream_counters").agg(*[F.sum(c).alias(c) for c in ("received", "accepted", "duplicates", "rejected")])


def rates(alerts: DataFrame, minutes: int = 10) -> DataFrame:
    """bucket (time of day), n and n_high of tumbling windows."""
    w = F.window("ts", f"{minutes} minutes")
    return alerts.groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("high", "critical")).alias("n_high")).select(F.date_format("window.start", "HH:mm").alias("bucket"), "n", "n_high")


def filled_rates(alerts: DataFrame, minutes: int = 10) -> DataFrame:
    """A row for each bucket of a day, with zeros."""
    spark = alerts.sparkSession
    day = spark.range(24 * 60 // minutes).select(F.format_string("%02d:%02d", F.expr(f"id * {minutes} div 60"), F.expr(f"id * {minutes} % 60")).alias("bucket"))
    own = rates(alerts, minutes).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_high").alias("n_high"))
    return day.join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_high", F.lit(0)).alias("n_high"))


def escalations(incidents: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Events and the new state. incidents: key (the earliest alert), severity; state: key, best.

    An event is an incident of high severity or more that is above its best so far; it is new if the key was
    never seen, else escalated. The state keeps the best of each key.
    """
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in RANKS.items()], F.lit(0))
    now = incidents.withColumn("rank", rank)
    joined = now.withColumn("best", F.lit(None).cast("int")) if state is None else now.join(state, "key", "left")
    events = joined.filter((F.col("rank") >= 2) & (F.col("rank") > F.coalesce("best", F.lit(-1)))).withColumn("kind", F.when(F.col("best").isNull(), "new").otherwise("escalated"))
    own = now.groupBy("key").agg(F.max("rank").alias("best"))
    new = own if state is None else own.unionByName(state).groupBy("key").agg(F.max("best").alias("best"))
    return events.drop("rank", "best"), new


def reanalysis(root: str, users: DataFrame, hosts: DataFrame | None = None, cfg: Correlation = Correlation(), board_size: int = 8) -> Callable[[DataFrame, int], None]:
    """For ingest_batch(): analyses all alerts so far, and writes the board, the new events, the best severity of each incident and the numbers of incidents.

    Each table has a part for each batch, so a batch that is run again gives the same tables; the state is read
    from the last batch before.
    """

    def run(alerts: DataFrame, number: int) -> None:
        spark = alerts.sparkSession
        if alerts.isEmpty():
            return
        before = _known(spark, root, "stream_state")
        if before is not None:
            last = before.filter(F.col("batch") < number).agg(F.max("batch")).first()[0]
            before = before.filter(F.col("batch") == last).drop("batch") if last is not None else None
        with shared.scratch(spark):
            found = pipeline.analyze(alerts, users, hosts, cfg).incidents.withColumn("key", F.col("first_alert"))
            found = shared.written(found.select("key", "incident_name", "title", "severity", "risk_score", "n_alerts", "first_us", "last_us"), "stream-incidents")
            events, state = escalations(found, before)
            counts = found.agg(F.count(F.lit(1)).alias("incidents"), *[F.count_if(F.col("severity") == s).alias(s) for s in RANKS])
            for name, part in (("stream_board", board(found, board_size)), ("stream_events", events), ("stream_state", state), ("stream_analyses", counts)):
                part.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")

    return run


def feed(spark: SparkSession, root: str, size: int = 40) -> DataFrame:
    """The newest events, the last batch's first."""
    return tables.read(spark, root, "stream_events").orderBy(F.desc("batch"), F.desc("risk_score"), "key").limit(size)


def snapshot(spark: SparkSession, root: str, rows_total: int | None = None) -> DataFrame:
    """One row: rows seen (and their share of rows_total), alerts, duplicates, rejected, incidents of the last analysis and their severities, alerts for each incident, analyses."""
    seen = counters(spark, root)
    all_ = tables.read(spark, root, "stream_analyses")
    names = ["incidents", *RANKS]
    last = all_.agg(F.count(F.lit(1)).alias("analyses"), *[F.max_by(c, "batch").alias(c) for c in names])
    out = seen.crossJoin(last)
    return out.select(
        F.col("received").alias("rows_seen"), (F.least(F.lit(1.0), F.round(F.col("received") / rows_total, 4)) if rows_total else F.lit(None).cast("double")).alias("progress"), F.col("accepted").alias("alerts"), "duplicates", "rejected",
        *names, (F.col("critical") + F.col("high")).alias("critical_high"), F.when(F.col("incidents") > 0, F.round(F.col("accepted") / F.col("incidents"), 2)).alias("compression_ratio"), "analyses",
    )


def board(incidents: DataFrame, size: int = 8) -> DataFrame:
    return incidents.orderBy(F.desc("risk_score"), "first_us").limit(size)


def bounded_dedup(stream: DataFrame, time: str, key: str, horizon: str = "1 day") -> DataFrame:
    """The scalable variant, off by default: state for a key ends with the watermark, later copies count as new."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
