"""The whole analysis: alerts to ranked incidents, as one plan of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators import anomaly, chain, correlate, entities, iforest, incidents, ingest, techniques
from alertmill.operators.correlate import Correlation
from alertmill.operators.hot import sent_if_small
from alertmill.sources.readers import ip_to_host
from alertmill.sources import tables
from alertmill.sources.shared import bucketed, scratch, written


@dataclass
class Analysis:
    """Results; what incidents do not depend on (reasons, evidence) is made and written when it is asked for."""

    incidents: DataFrame
    members: DataFrame
    links: DataFrame  # memberships without reasons
    sides: DataFrame  # correlate.meeting()
    edges: DataFrame
    entities: DataFrame
    entity_stats: DataFrame

    @cached_property
    def memberships(self) -> DataFrame:
        return written(correlate.explained(self.links, self.sides), "memberships")

    @cached_property
    def stages(self) -> DataFrame:
        return written(chain.stage_rollup(chain.staged(self.members)), "stages")

    @cached_property
    def mappings(self) -> DataFrame:
        return written(techniques.mapped(self.members), "mappings")


def correlated(alerts: DataFrame, hosts: DataFrame | None = None, cfg: Correlation = Correlation(), words: bool = True, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """weights, pairs (no table: they are found again where they are read), edges and groups (pos, component). words: edges have what reasons are made of; whole: with groups, else None."""
    weights, each = met(alerts, hosts, cfg)
    pairs = correlate.met_pairs(each, cfg)
    edges, groups = linked(each, alerts, cfg, words, whole)
    return weights, pairs, edges, groups


def met(alerts: DataFrame, hosts: DataFrame | None = None, cfg: Correlation = Correlation()) -> tuple[DataFrame, DataFrame]:
    """weights, and meeting() of alerts."""
    weights = written(entities.entity_stats(alerts), "entity-stats")
    return weights, correlate.meeting(alerts, weights, ip_to_host(hosts) if hosts is not None else None, cfg)


def linked(each: DataFrame, alerts: DataFrame, cfg: Correlation = Correlation(), words: bool = True, whole: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """edges and groups, as of correlated()."""
    edges = written(correlate.scored_edges(each, alerts, cfg, words), "scored-edges")
    return edges, written(correlate.grouped(edges, alerts), "groups") if whole else None


def scored(alerts: DataFrame, users: DataFrame, forest: bool = True) -> DataFrame:
    """alerts with features, rule_score, anomaly_score and notes. With fewer than 20 alerts the rule score stands alone."""
    rows = anomaly.rule_scores(anomaly.features(alerts, users), "pos")
    if forest and rows.count() >= 20:
        raw = written(iforest.score(rows, iforest.fit(rows)), "forest-raw")
        rows = anomaly.blended(rows.join(raw, "pos"), scores=raw)
    else:
        rows = rows.withColumn("anomaly_score", F.col("rule_score"))
    return anomaly.notes(rows)


def analyze(alerts: DataFrame, users: DataFrame, hosts: DataFrame | None = None, cfg: Correlation = Correlation(), decisions: DataFrame | None = None, forest: bool = True, cut: bool = True) -> Analysis:
    """Everything that follows from canonical alerts and contexts. Tables read more than once are written to the shared folder."""
    alerts = written(alerts, "alerts")
    weights, each = met(alerts, hosts, cfg)
    edges, groups = linked(each, alerts, cfg, words=False)
    if cut:
        groups = written(correlate.recut(groups, edges, cfg), "cut-groups")
    links = written(correlate.memberships(groups, edges, reasons=False), "links")
    scores = scored(alerts, users, forest)
    members = scores.join(groups.select("pos", F.concat(F.lit("C"), "component").alias("incident_id")), "pos")
    members = bucketed(members, "incident_id", "members")
    stages = written(chain.stage_rollup(chain.staged(members), evidence=False), "stage-times")
    mappings = written(techniques.mapped(members, evidence=False), "techniques")
    sure = correlate.confidences(links).select(F.concat(F.lit("C"), "component").alias("incident_id"), "confidence")
    env = incidents.envelope(members).withColumn("evidence_hash", incidents.evidence_hash(F.col("alert_ids"), cfg))
    factors = incidents.base_factors(members, chain.chain_strength(stages), anomaly.incident_anomaly(members), sure, mappings)
    risk = incidents.risk(env.join(factors, "incident_id"), decisions)
    ents = written(incidents.incident_entities(entities.entity_links(members, "incident_id"), sent_if_small(weights, correlate.SENT_ROWS)), "incident-entities")
    names = incidents.titles(members, stages, mappings, incidents.primary_entities(ents))
    full = risk.join(names, "incident_id").join(incidents.top_types(members), "incident_id").join(anomaly.incident_notes(members).withColumnRenamed("notes", "anomaly_notes"), "incident_id", "left")
    return Analysis(incidents.ranked(written(full, "incidents")), members, links, each, edges, ents, weights)


def persist(found: Analysis, alerts: DataFrame, root: str, run_id: str) -> None:
    """Writes a run's result tables to root in full, a row to pipeline_runs, and alerts with their incident and scores.

    Alerts go by day to alerts_scored, so that root's alerts, which they may come from, stay as they are; days that the run does not have are left alone.
    """
    kept = [c for c in found.incidents.columns if c != "alert_ids"]
    tables.replace(found.incidents.select("incident_id", "alert_ids", *[c for c in kept if c != "incident_id"]), root, "incidents")
    members = found.memberships.withColumn("incident_id", F.concat(F.lit("C"), "component"))
    ids = found.members.select("pos", "alert_id")
    tables.replace(members.join(ids, "pos").join(ids.select(F.col("pos").alias("linked"), F.col("alert_id").alias("linked_alert_id")), "linked", "left").select("incident_id", "alert_id", "linked_alert_id", "link_score", "reasons"), root, "incident_alerts")
    tables.replace(found.entities, root, "incident_entities")
    tables.replace(found.stages, root, "attack_stages")
    tables.replace(found.mappings, root, "incident_mitre")
    tables.append(incidents.run_stats(alerts, found.incidents).withColumn("run_id", F.lit(run_id)), root, "pipeline_runs")
    scores = found.members.select("alert_id", "incident_id", "rule_score", "anomaly_score")
    scored_alerts = tables.with_results(alerts, scores.select("alert_id", "incident_id"), scores)
    tables.replace_days(scored_alerts.withColumn("day", F.to_date("ts")), root, "alerts_scored")


def run(alerts: DataFrame, users: DataFrame, root: str, run_id: str, hosts: DataFrame | None = None, cfg: Correlation = Correlation(), decisions: DataFrame | None = None) -> None:
    """The whole job: analyses alerts and writes all results; tables in between are deleted."""
    with scratch(alerts.sparkSession):
        persist(analyze(alerts, users, hosts, cfg, decisions), alerts, root, run_id)


def store_batch(rows: DataFrame, root: str, batch_id: str, number: int, source_name: str | None = None) -> None:
    """Stores a batch (rows of ingest.classified()): its row of the log, its accepted alerts by day, and the counters of the stored alerts that its duplicates repeat.

    Only the days of the batch are read and only those with changes written. A batch that is stored again, under the
    same id and number, changes nothing; numbers must rise from batch to batch.
    """
    spark = rows.sparkSession
    with scratch(spark):
        rows = written(rows, "batch")
        tables.replace_days(ingest.batch_record(rows, batch_id, source_name), root, "ingest_batches", "batch_id")
        new = rows.filter("status = 'accepted'").drop("status", "duplicate_of", "errors").withColumns({"batch_id": F.lit(batch_id), "merged_by": F.lit(None).cast("long"), "day": F.to_date("ts")})
        days = [r[0] for r in new.select("day").distinct().collect()]  # one row a day
        if tables.exists(spark, root, "alerts"):
            stored = tables.read(spark, root, "alerts").filter(F.col("day").isin(days) & (F.col("batch_id") == batch_id)).select("alert_id")
            new = new.join(stored, "alert_id", "left_anti").select(*new.columns)
        tables.append(written(new, "new-alerts"), root, "alerts", by="day")
        own = rows.filter("status = 'accepted'").select(F.col("alert_id").alias("_own"))
        later = rows.filter("status = 'duplicate'").join(own, F.col("duplicate_of") == F.col("_own"), "left_anti")  # those inside the batch are counted already
        tables.raise_duplicates(spark, root, later, number)
