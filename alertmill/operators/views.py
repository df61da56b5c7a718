"""Read queries over alerts, incidents and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search_alerts(alerts: DataFrame, q: str | None = None, **facets: str | None) -> DataFrame:
    """Alerts whose title, id, user, host or type holds q, or whose src_ip starts with it, and whose facets are equal (host: upper-cased)."""
    out = alerts
    if q:
        low = q.lower()
        out = out.filter(
            F.lower("title").contains(low) | F.col("alert_id").contains(q.upper()) | F.lower("user").contains(low) | F.lower("host").contains(low) | F.col("src_ip").startswith(q) | F.lower("alert_type").contains(low)
        )
    for name, value in facets.items():
        if value is not None:
            out = out.filter(F.col(name) == (value.upper() if name == "host" else value))
    return out


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page, each row with total, the number of all rows found."""
    return page(rows, order, limit, offset).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def technique(known: DataFrame, technique_id: str) -> DataFrame:
    """The row of one technique, by its id in any case."""
    return known.filter(F.col("technique_id") == technique_id.strip().upper())


def incident_queue(incidents: DataFrame, min_risk: float = 0.0, severities: list[str] | None = None, statuses: list[str] | None = None, q: str | None = None, technique: str | None = None, sort: str = "risk") -> DataFrame:
    out = incidents.filter(F.col("risk_score") >= min_risk)
    if severities:
        out = out.filter(F.col("severity").isin(severities))
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    if q:
        out = out.filter(F.lower("title").contains(q.lower()) | F.lower("incident_name").contains(q.lower()))
    if technique:
        out = out.filter(F.array_contains("technique_ids", technique.upper()))
    order = {"risk": [F.desc("risk_score"), F.asc("first_us")], "recent": [F.desc("last_us")], "alerts": [F.desc("n_alerts")]}[sort]
    return out.orderBy(*order, "incident_id")


def with_membership(alerts: DataFrame, memberships: DataFrame, how: str = "left") -> DataFrame:
    return alerts.join(memberships, "alert_id", how)


def assembled(incidents: DataFrame, stages: DataFrame, mappings: DataFrame, entities: DataFrame) -> DataFrame:
    """incidents with arrays of their stages (in order), techniques (most certain first) and entities."""
    collect = lambda df, name, first, *cols: df.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(*first, *cols))).alias(name))
    a = collect(stages, "stages", ["first_us", "stage_order"], "stage", "label", "n_alerts", "confidence")
    b = collect(mappings, "techniques", ["place"], "technique_id", "name", "confidence", "reason")
    c = collect(entities, "entities", ["place"], "type", "value", "role", "n_alerts", "rarity")
    return incidents.join(a, "incident_id", "left").join(b, "incident_id", "left").join(c, "incident_id", "left")


def latest(rows: DataFrame, key: str, time: str, prefer=None, tie: str | None = None) -> DataFrame:
    """The newest row of each key; prefer (a boolean column) goes before time."""
    order = ([F.desc(prefer)] if prefer is not None else []) + [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_place = 1").drop("_place")


def status_of(verdict):
    """The status that a verdict puts an incident in."""
    return F.when(verdict.isin("false_positive", "benign_true_positive"), "closed").otherwise("triaged")


def with_feedback(incidents: DataFrame, feedback: DataFrame) -> DataFrame:
    """incidents with the last verdict on their evidence, and status new or triaged. feedback: evidence_hash, verdict, created_us, feedback_id."""
    last = feedback.groupBy("evidence_hash").agg(F.max_by("verdict", F.struct("created_us", "feedback_id")).alias("verdict"))
    return incidents.join(last, "evidence_hash", "left").withColumn("status", F.when(F.col("verdict").isNotNull(), "triaged").otherwise("new"))


def undecided(incidents: DataFrame, decisions: DataFrame, n: int) -> DataFrame:
    """Of the n riskiest incidents those whose evidence has no decision that is ok."""
    top = incidents.orderBy(F.desc("risk_score"), "first_us", "incident_id").limit(n)
    return top.join(decisions.filter("status = 'ok'").select("evidence_hash"), "evidence_hash", "left_anti")


def overview(alerts: DataFrame) -> DataFrame:
    """severity and n."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def headline(batches: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: rows received, accepted, duplicates and rejected, alerts, incidents, those of each severity, critical_high, and alerts for each incident and for each critical or high one.

    batches: rows of ingest.batch_summary().
    """
    a = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "accepted", "duplicates", "rejected")])
    b = incidents.agg(F.count(F.lit(1)).alias("incidents"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    out = a.crossJoin(alerts.agg(F.count(F.lit(1)).alias("alerts"))).crossJoin(b).withColumn("critical_high", F.col("critical") + F.col("high"))
    some = F.col("incidents") > 0
    return out.withColumns({"compression_ratio": F.when(some, F.round(F.col("alerts") / F.col("incidents"), 2)), "actionable_ratio": F.when(some, F.round(F.col("alerts") / F.greatest(F.lit(1), F.col("critical_high")), 1))})


def hour_matrix(alerts: DataFrame) -> DataFrame:
    """hour of day and the number of alerts of each severity."""
    kinds = ["critical", "high", "medium", "low", "informational"]
    return alerts.groupBy(F.hour("ts").cast("int").alias("hour")).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in kinds])


def verdict_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def cache_counts(decisions: DataFrame, briefs: DataFrame) -> DataFrame:
    """One row: decisions that are ok, and briefs that are and come from no template."""
    a = decisions.agg(F.count_if(F.col("status") == "ok").alias("decisions"))
    return a.crossJoin(briefs.agg(F.count_if((F.col("status") == "ok") & (F.col("provider") != "template")).alias("briefs")))
