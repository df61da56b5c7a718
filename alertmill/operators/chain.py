"""Attack stages of incidents, in order, and how strong the chain is. members: incident_id, pos, us, alert_id, alert_type, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import catalog

#: Failures below which an incident's failed sign-ins are no attack.
LEAST_FAILURES = 5


def staged(members: DataFrame) -> DataFrame:
    """members with stage (null: none). Plain sign-ins become access after a credential attack earlier in the incident."""
    failing = F.col("alert_type").isin("failed_login", "account_lockout")
    whole = Window.partitionBy("incident_id")
    before = Window.partitionBy("incident_id").orderBy("us", "pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(failing & (F.col("_fails") < LEAST_FAILURES), F.lit(None).cast("string")).otherwise(catalog.of_type("stage", F.col("alert_type")))
    out = members.withColumn("_fails", F.sum(failing.cast("int")).over(whole)).withColumn("stage", own)
    seen = F.coalesce(F.max((F.col("stage") == "credential_attack").cast("int")).over(before), F.lit(0))
    return out.withColumn("_seen", seen).withColumn("stage", F.when((F.col("alert_type") == "login_success") & (F.col("_seen") == 1), "valid_access").otherwise(F.col("stage"))).drop("_fails", "_seen")


def stage_rollup(rows: DataFrame, evidence: bool = True) -> DataFrame:
    """incident_id, stage, label, stage_order, first_us, last_us, n_alerts and, if asked for, alert_ids (in time order), alert_types, confidence."""
    plain = [F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n_alerts")]
    by_stage = rows.filter("stage is not null").groupBy("incident_id", "stage")
    if not evidence:
        return by_stage.agg(*plain).withColumns({"label": catalog.stage_label(F.col("stage")), "stage_order": catalog.stage_order(F.col("stage"))})
    out = by_stage.agg(
        *plain, F.array_sort(F.collect_list(F.struct("us", "pos", "alert_id"))).getField("alert_id").alias("alert_ids"), F.array_sort(F.collect_set("alert_type")).alias("alert_types"), F.avg("confidence").alias("mean")
    )
    sure = F.round(F.least(F.lit(0.99), F.col("mean") * (0.85 + 0.15 * F.least(F.lit(1.0), F.col("n_alerts") / 5))), 3)
    return out.withColumns({"mean_confidence": F.col("mean"), "label": catalog.stage_label(F.col("stage")), "stage_order": catalog.stage_order(F.col("stage")), "confidence": sure}).drop("mean")


def chain_strength(stages: DataFrame) -> DataFrame:
    """incident_id, n_stages, chain_strength: how many stages, in how orderly a sequence, and whether the first way in leads further."""
    by_time = Window.partitionBy("incident_id").orderBy("first_us", "stage_order")
    entry = F.col("stage").isin("initial_access", "credential_attack", "valid_access")
    rows = stages.withColumns({"_before": F.lag("stage_order").over(by_time), "_entry_at": F.min(F.when(entry, F.col("first_us"))).over(Window.partitionBy("incident_id"))})
    out = rows.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n_stages"), F.count_if(F.col("_before") <= F.col("stage_order")).alias("_ordered"), F.max((~entry & (F.col("first_us") >= F.col("_entry_at"))).cast("int")).alias("_further"),
    )
    coverage = F.least(F.lit(1.0), (F.col("n_stages") - 1) / 4)
    coherence = F.when(F.col("n_stages") > 1, F.col("_ordered") / (F.col("n_stages") - 1)).otherwise(0.0)
    value = F.least(F.lit(1.0), coverage * (0.7 + 0.3 * coherence) + 0.15 * F.coalesce(F.col("_further"), F.lit(0)))
    return out.select("incident_id", "n_stages", F.round(value, 4).alias("chain_strength"))
