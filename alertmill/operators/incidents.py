"""Incidents from groups of alerts: factors, risk, entities, titles, ranks and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import normalize
from alertmill.operators.correlate import Correlation
from alertmill.sources.shared import written

FACTORS = ["base_severity", "asset_criticality", "identity_privilege", "attack_chain_strength", "anomaly_score", "correlation_confidence", "blast_radius", "threat_mapping_confidence"]
WEIGHTS = dict(zip(FACTORS, (0.20, 0.18, 0.14, 0.16, 0.10, 0.10, 0.07, 0.05), strict=True))
#: with a decision: blast radius gives way to its signal
DECIDED = {"base_severity": 0.20, "asset_criticality": 0.17, "identity_privilege": 0.12, "attack_chain_strength": 0.14, "anomaly_score": 0.12, "correlation_confidence": 0.10, "decision_signal": 0.15}
LEAST_CONFIDENCE = 0.55

# --- fixed values: titles are results -----------------------------------------------------------------
SPRAY, SPRAY_SOURCE, SPRAY_WORKED = "Password spray from ", "external source", " with successful sign-ins"
THEFT, THEFT_SENT = "Credential theft on ", " and data exfiltration"
COMPROMISE = ("Possible ", "privileged account", "account", " compromise: ")
TRAVEL, DOCUMENT, EXFILTRATION = "Impossible travel and suspicious mailbox access: ", "Malicious document execution on ", "Possible data exfiltration from "
# ------------------------------------------------------------------------------------------------------


def base_factors(members: DataFrame, chains: DataFrame, anomalies: DataFrame, confidences: DataFrame, mappings: DataFrame) -> DataFrame:
    """incident_id and the eight factors, rounded to 4 digits. chains, anomalies, confidences and mappings are by incident_id; missing: 0."""
    by_severity = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("severity_score"), "pos"))
    top = members.select("incident_id", "severity_score", "pos").withColumn("_place", by_severity).filter("_place <= 10").groupBy("incident_id").agg((0.5 * F.max("severity_score") / 100 + 0.5 * F.avg("severity_score") / 100).alias("base_severity"))
    own = F.array_compact(
        F.array(
            F.when(F.col("user").isNotNull(), F.concat(F.lit("u:"), "user")), F.when(F.col("host").isNotNull(), F.concat(F.lit("h:"), "host")), F.when(F.col("resource").isNotNull(), F.concat(F.lit("r:"), "resource")),
            F.when(F.col("src_ip").isNotNull() & ~F.col("src_ip_private"), F.concat(F.lit("ip:"), "src_ip")),
        )
    )
    wide = members.select("incident_id", F.explode(own).alias("thing")).groupBy("incident_id").agg(F.count_distinct("thing").alias("things"))
    plain = members.groupBy("incident_id").agg((F.max("asset_criticality") / 5).alias("asset_criticality"), F.coalesce(F.max(F.when(F.col("user").isNotNull(), F.col("user_privilege"))) / 5, F.lit(0.2)).alias("identity_privilege"))
    best = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("confidence"), "technique_id"))
    threat = mappings.select("incident_id", "technique_id", "confidence").withColumn("_place", best).filter("_place <= 3").groupBy("incident_id").agg((F.sum("confidence") / 3).alias("threat_mapping_confidence"))
    out = plain.join(top, "incident_id").join(wide, "incident_id", "left").join(threat, "incident_id", "left")
    out = out.join(chains.select("incident_id", F.col("chain_strength").alias("attack_chain_strength")), "incident_id", "left").join(anomalies.select("incident_id", F.col("anomaly").alias("anomaly_score")), "incident_id", "left")
    out = out.join(confidences.select("incident_id", F.col("confidence").alias("correlation_confidence")), "incident_id", "left")
    out = out.withColumn("blast_radius", F.least(F.lit(1.0), F.log2(1 + F.coalesce(F.col("things"), F.lit(0))) / F.log2(F.lit(21.0))))
    return out.select("incident_id", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c) for c in FACTORS])


def decision_signal(decisions: DataFrame) -> DataFrame:
    """decisions with decision_signal and needs_review: p_malicious, severity and p_escalate weighted; an unsure one moves toward 0.5."""
    raw = 0.55 * F.coalesce("p_malicious", F.lit(0.0)) + 0.30 * F.coalesce("severity_normalized", F.lit(0.0)) + 0.15 * F.coalesce("p_escalate", F.lit(0.0))
    sure = F.coalesce("disposition_confidence", F.lit(1.0))
    value = F.when(sure < LEAST_CONFIDENCE, 0.5 + (raw - 0.5) * sure / LEAST_CONFIDENCE).otherwise(raw)
    return decisions.withColumns({"decision_signal": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4), "needs_review": sure < LEAST_CONFIDENCE})


def _score(weights: dict[str, float]) -> tuple[Column, Column]:
    """Contributions (hundredths of a point) and score (tenths), in whole numbers: ties round up in any order of summing."""
    cents = {k: F.floor((F.round(F.col(k) * 10_000).cast("long") * round(100 * w) + 50) / 100) for k, w in weights.items()}
    total = sum(cents.values(), F.lit(0))
    return F.create_map(*[x for k, v in cents.items() for x in (F.lit(k), v / 100)]), F.floor((F.greatest(F.lit(0), F.least(F.lit(10_000), total)) + 5) / 10) / 10


def risk(factors: DataFrame, decisions: DataFrame | None = None, on: str = "evidence_hash") -> DataFrame:
    """factors with contributions, risk_score, severity, formula and deterministic_score. decisions: on and the columns of decision_signal()."""
    parts, score = _score(WEIGHTS)
    out = factors.withColumns({"contributions": parts, "deterministic_score": score})
    if decisions is None:
        out = out.withColumns({"risk_score": F.col("deterministic_score"), "formula": F.lit("v1-deterministic")})
    else:
        out = out.join(decision_signal(decisions).select(on, "decision_signal", "needs_review"), on, "left")
        parts2, score2 = _score(DECIDED)
        decided = F.col("decision_signal").isNotNull()
        out = out.withColumns({"contributions": F.when(decided, parts2).otherwise(F.col("contributions")), "risk_score": F.when(decided, score2).otherwise(F.col("deterministic_score")), "formula": F.when(decided, "v2-decision").otherwise("v1-deterministic")})
    return out.withColumn("severity", normalize.risk_label(F.col("risk_score")))


def envelope(members: DataFrame) -> DataFrame:
    """incident_id, first_us, last_us, alert_ids (in time order), n_alerts, duplicates, first_alert."""
    out = members.groupBy("incident_id").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.array_sort(F.collect_list(F.struct("us", "pos", "alert_id"))).getField("alert_id").alias("alert_ids"), F.count(F.lit(1)).alias("n_alerts"),
        F.sum("duplicate_count").alias("duplicates"),
    )
    return out.withColumn("first_alert", F.col("alert_ids")[0])


def top_values(members: DataFrame, column: str, name: str) -> DataFrame:
    """incident_id and the most frequent value of a column (ties: the first seen)."""
    counts = members.filter(F.col(column).isNotNull()).groupBy("incident_id", column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("us", "pos")).alias("at"))
    return counts.groupBy("incident_id").agg(F.max_by(column, F.struct("n", -F.col("at.us"), -F.col("at.pos"))).alias(name))


def top_types(members: DataFrame, top: int = 5) -> DataFrame:
    """incident_id and top_alert_types, an array of (alert_type, n)."""
    counts = members.groupBy("incident_id", "alert_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("us", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("n"), "at"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alert_type", "n"))), lambda x: F.struct(x["alert_type"].alias("alert_type"), x["n"].alias("n"))).alias("top_alert_types"))


def incident_entities(links: DataFrame, weights: DataFrame) -> DataFrame:
    """incident_id, type, value, role, n_alerts, rarity, score, place (by score). links: entity_links() with incident_id."""
    out = links.groupBy("incident_id", "entity_key", "type", "value", "role").agg(F.count(F.lit(1)).alias("n_alerts")).join(weights.select("entity_key", F.col("weight").alias("rarity")), "entity_key")
    out = out.withColumn("score", F.col("rarity") * F.col("n_alerts"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "type", "value", "role"))
    return out.withColumn("place", place).drop("entity_key")


def primary_entities(entities: DataFrame) -> DataFrame:
    """The first five entities of rarity 0.2 or more of each incident, or else its first three."""
    rare, whole = F.col("rarity") >= 0.2, Window.partitionBy("incident_id")
    ranked = entities.withColumns({"_all": F.count_if(rare).over(whole), "_upto": F.count_if(rare).over(whole.orderBy("place"))})
    place = F.when(F.col("_all") == 0, F.when(F.col("place") <= 3, F.col("place"))).when(rare & (F.col("_upto") <= 5), F.col("_upto").cast("int"))
    return ranked.withColumn("primary_place", place).filter("primary_place is not null").drop("_all", "_upto")


def titles(members: DataFrame, stages: DataFrame, mappings: DataFrame, primary: DataFrame) -> DataFrame:
    """incident_id and title, by the first case that holds of stages and techniques."""
    sizes = members.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    st = stages.groupBy("incident_id").agg(F.collect_set("stage").alias("st"))
    tech = mappings.groupBy("incident_id").agg(F.collect_set("technique_id").alias("tech"))
    one = primary.filter("primary_place = 1").select("incident_id", F.col("value").alias("entity"))
    t = sizes
    for x in (st, tech, one, top_values(members, "user", "user"), top_values(members, "host", "host"), top_values(members, "title", "top"), top_values(members.filter("alert_type = 'failed_login'"), "src_ip", "source")):
        t = t.join(x, "incident_id", "left")
    power = members.groupBy("incident_id", "user").agg(F.max("user_privilege").alias("power"))
    t = t.join(power, ["incident_id", "user"], "left").withColumns({"st": F.coalesce("st", F.array().cast("array<string>")), "tech": F.coalesce("tech", F.array().cast("array<string>"))})
    has = lambda *x: [F.array_contains("st", v) for v in x]
    cred, valid, run, priv, res, theft, exfil, entry = has("credential_attack", "valid_access", "execution", "privilege_persistence", "resource_access", "credential_theft", "exfiltration", "initial_access")
    none = F.lit("None")
    user, host = F.coalesce("user", none), F.coalesce("host", none)
    subject = F.coalesce("user", "host", "entity", F.lit("unknown"))
    return t.select(
        "incident_id",
        F.when(F.array_contains("tech", "T1110.003"), F.concat(F.lit(SPRAY), F.coalesce("source", F.lit(SPRAY_SOURCE)), F.when(valid, SPRAY_WORKED).otherwise("")))
        .when(theft, F.concat(F.lit(THEFT), host, F.when(exfil, THEFT_SENT).otherwise("")))
        .when(cred & valid & (run | priv | res), F.concat(F.lit(COMPROMISE[0]), F.when(F.col("power") >= 4, COMPROMISE[1]).otherwise(COMPROMISE[2]), F.lit(COMPROMISE[3]), user))
        .when(F.array_contains("tech", "T1078.004"), F.concat(F.lit(TRAVEL), user))
        .when(entry & run, F.concat(F.lit(DOCUMENT), host))
        .when(exfil, F.concat(F.lit(EXFILTRATION), host))
        .when(F.col("n") == 1, F.concat("top", F.lit(": "), subject))
        .otherwise(F.format_string("%s (%d alerts): %s", "top", "n", subject)).alias("title"),
    )


def evidence_hash(alert_ids: Column, cfg: Correlation = Correlation()) -> Column:
    """20 hexadecimal digits of the sorted ids and of what correlation depends on."""
    return F.substring(F.sha2(F.concat_ws("|", F.concat_ws(",", F.array_sort(alert_ids)), F.lit(cfg.version), F.lit(str(cfg.threshold)), F.lit(str(cfg.window_minutes))), 256), 1, 20)


def ranked(incidents: DataFrame) -> DataFrame:
    """incidents with rank (risk, then first seen) and incident_name INC-0001, ...

    One row for each incident is sorted in sampled ranges; a range's ranks follow from the sizes of those
    before it (a row for each range), so the global order is no one task's work.
    """
    order = [F.desc("risk_score"), F.asc("first_us"), F.asc("first_alert")]
    parts = int(incidents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = incidents.withColumns({"_a": -F.col("risk_score"), "_b": F.col("first_us"), "_c": F.col("first_alert")})
    spread = place.repartitionByRange(parts, "_a", "_b", "_c").withColumn("_range", F.spark_partition_id())
    inside = written(spread.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "ranked")
    sizes = inside.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    out = inside.join(F.broadcast(before), "_range").withColumn("rank", (F.col("_before") + F.col("_in")).cast("long"))
    return out.withColumn("incident_name", F.format_string("INC-%04d", "rank")).drop("_a", "_b", "_c", "_range", "_in", "_before")


def run_stats(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: alerts, incidents, incidents of each severity, compression."""
    counts = incidents.agg(F.count(F.lit(1)).alias("incidents"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    both = alerts.agg(F.count(F.lit(1)).alias("alerts")).crossJoin(counts)
    return both.withColumn("compression", F.round(F.col("alerts") / F.greatest(F.lit(1), F.col("incidents")), 2))
