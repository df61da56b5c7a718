"""What is written about incidents: checks of citations, playbook checks, evidence samples, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import normalize

MAX_EVIDENCE, MAX_CHECKS, MAX_FACTS = 40, 6, 12


def citation_reports(briefs: DataFrame, members: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """brief_id, dropped_facts (without a citation), citations_checked, invalid_citations, unknown_techniques, valid.

    briefs: brief_id, incident_id, facts array<struct<fact, alert_ids>>, technique_ids array; members: incident_id,
    alert_id; mappings: incident_id, technique_id; known: technique_id.
    """
    cited = briefs.select("brief_id", "incident_id", F.explode(F.flatten(F.transform(F.coalesce("facts", F.array().cast("array<struct<fact:string,alert_ids:array<string>>>")), lambda f: F.coalesce(f["alert_ids"], F.array().cast("array<string>"))))).alias("alert_id"))
    wrong = cited.join(members.select("incident_id", "alert_id").distinct(), ["incident_id", "alert_id"], "left_anti").groupBy("brief_id").agg(F.count(F.lit(1)).alias("invalid_citations"))
    checked = cited.groupBy("brief_id").agg(F.count(F.lit(1)).alias("citations_checked"))
    named = briefs.select("brief_id", "incident_id", F.explode("technique_ids").alias("technique_id"))
    right = mappings.select("incident_id", "technique_id").distinct().join(known.select("technique_id"), "technique_id", "left_semi")
    strange = named.join(right, ["incident_id", "technique_id"], "left_anti").groupBy("brief_id").agg(F.array_sort(F.collect_set("technique_id")).alias("unknown_techniques"))
    bare = F.size(F.filter(F.coalesce("facts", F.array().cast("array<struct<fact:string,alert_ids:array<string>>>")), lambda f: F.coalesce(F.size(f["alert_ids"]), F.lit(0)) <= 0))
    out = briefs.select("brief_id", "incident_id", bare.alias("dropped_facts"))
    for x in (checked, wrong, strange):
        out = out.join(x, "brief_id", "left")
    out = out.withColumns({"citations_checked": F.coalesce("citations_checked", F.lit(0)), "invalid_citations": F.coalesce("invalid_citations", F.lit(0)), "unknown_techniques": F.coalesce("unknown_techniques", F.array().cast("array<string>"))})
    return out.withColumn("valid", (F.col("invalid_citations") == 0) & (F.size("unknown_techniques") == 0))


def checks(mappings: DataFrame, stages: DataFrame, playbook: DataFrame, incidents: DataFrame, general: str, default: str, limit: int = MAX_CHECKS) -> DataFrame:
    """incident_id and checks: the playbook's lines by technique, then by stage, each once; then the general line; six at most.

    playbook: key_type (technique or stage), key, pos, text.
    """
    asked = mappings.select("incident_id", F.lit("technique").alias("key_type"), F.col("technique_id").alias("key"), F.struct(F.lit(0).alias("a"), F.col("place").cast("long").alias("b")).alias("at")).unionByName(
        stages.select("incident_id", F.lit("stage").alias("key_type"), F.col("stage").alias("key"), F.struct(F.lit(1).alias("a"), F.col("first_us").alias("b")).alias("at"))
    )
    lines = asked.join(playbook, ["key_type", "key"]).groupBy("incident_id", "text").agg(F.min(F.struct("at", "pos")).alias("at"))
    found = lines.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).getField("text").alias("found"))
    full = incidents.select("incident_id").join(found, "incident_id", "left").withColumn("found", F.coalesce("found", F.array(F.lit(default))))
    return full.select("incident_id", F.slice(F.concat("found", F.array(F.lit(general))), 1, limit).alias("checks"))


def evidence_sample(rows: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """The alerts of each incident that stand for it: of each stage the first three and the last, then the first of each type not yet there, then the earliest; with flagged: text that speaks to programs.

    rows: members with stage, title and attributes (JSON text).
    """
    w = Window.partitionBy("incident_id", "stage")
    at = F.row_number().over(w.orderBy("us", "pos"))
    last = F.row_number().over(w.orderBy(F.desc("us"), F.desc("pos")))
    step = rows.withColumn("_by_stage", F.col("stage").isNotNull() & ((at <= 3) | (last == 1)))
    of_type = F.row_number().over(Window.partitionBy("incident_id", "alert_type", "_by_stage").orderBy("us", "pos"))
    step = step.withColumn("_prio", F.when(F.col("_by_stage"), 0).when(of_type == 1, 1).otherwise(2))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy("_prio", "us", "pos"))
    values = F.map_values(F.from_json("attributes", "map<string,string>"))
    flagged = normalize.has_instructions(F.col("title"), F.coalesce(values, F.array().cast("array<string>")))
    return step.withColumn("_place", place).filter(F.col("_place") <= limit).withColumn("flagged", flagged).drop("_by_stage", "_prio", "_place")


def asset_context(entities: DataFrame, users: DataFrame, hosts: DataFrame, resources: DataFrame, limit: int = 6) -> DataFrame:
    """incident_id, type, value, level, place: what the contexts know of an incident's users, hosts and resources, six of each at most."""
    known = (
        users.select(F.lit("user").alias("type"), F.col("user").alias("value"), F.col("privilege").alias("level"))
        .unionByName(hosts.select(F.lit("host").alias("type"), F.col("host").alias("value"), F.col("criticality").alias("level")))
        .unionByName(resources.select(F.lit("resource").alias("type"), F.col("resource").alias("value"), F.col("criticality").alias("level")))
    )
    joined = entities.groupBy("incident_id", "type", "value").agg(F.min("place").alias("at")).join(known, ["type", "value"])
    place = F.row_number().over(Window.partitionBy("incident_id", "type").orderBy("at", "value"))
    return joined.withColumn("place", place).filter(F.col("place") <= limit).drop("at")


def technique_context(mappings: DataFrame, known: DataFrame) -> DataFrame:
    """incident_id, technique_id, name, tactics and the first 300 characters of the description."""
    return mappings.select("incident_id", "technique_id").join(known.select("technique_id", "name", "tactics", F.substring("description", 1, 300).alias("description")), "technique_id")


#: Facts cite so many alerts, and come from so many techniques and anomaly notes.
CITED, FROM_TECHNIQUES, FROM_NOTES = 5, 5, 3
_NO_FACTS = "array<struct<fact:string,alert_ids:array<string>>>"
_NO_HYPOTHESES = "array<struct<hypothesis:string,confidence:double>>"


def summaries(incidents: DataFrame, stages: DataFrame, mappings: DataFrame, primary: DataFrame | None = None, playbook: DataFrame | None = None, general: str = "Compare with the users' and hosts' usual activity.", default: str = "Review the alerts in order of time.") -> DataFrame:
    """A brief of each incident, from the records alone: every fact cites alerts.

    incident_id, summary, facts (fact, alert_ids; twelve at most), hypotheses (hypothesis, confidence), why (the
    largest contributions to the risk), affected (type: value), techniques (technique_id, name, reason), checks,
    uncertainties, overall_confidence. incidents: incident_id, title, n_alerts, alert_ids, first_us, last_us,
    correlation_confidence, risk_score, severity, contributions, and if there, top_alert_types, anomaly_notes,
    chain_strength and anomaly_score; primary: primary_entities(); playbook: see checks().
    """
    time = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm 'UTC'")
    given = {"contributions": "map<string,double>", "alert_ids": "array<string>", "anomaly_notes": "array<string>", "chain_strength": "double", "anomaly_score": "double", "top_alert_types": "array<struct<alert_type:string,n:bigint>>"}
    t = incidents.withColumns({c: F.lit(None).cast(k) for c, k in given.items() if c not in incidents.columns})
    by_time = F.array_sort(F.collect_list(F.struct("first_us", "stage_order", "stage", "label", "n_alerts", "alert_types", "last_us", "alert_ids")))
    t = t.join(stages.groupBy("incident_id").agg(by_time.alias("s")), "incident_id", "left")
    t = t.join(mappings.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", "technique_id", "name", "reason", "confidence", "evidence"))).alias("m")), "incident_id", "left")
    if primary is not None:
        t = t.join(primary.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("primary_place", "type", "value"))).alias("e")), "incident_id", "left")
        t = t.withColumn("affected", F.coalesce(F.transform("e", lambda x: F.concat_ws(": ", x["type"], x["value"])), F.array().cast("array<string>")))
        user = F.coalesce(F.get(F.filter("e", lambda x: x["type"] == "user"), F.lit(0))["value"], F.lit("the account"))
    else:
        t, user = t.withColumn("affected", F.array().cast("array<string>")), F.lit("the account")
    if playbook is not None:
        t = t.join(checks(mappings, stages, playbook, incidents, general, default), "incident_id", "left")
    else:
        t = t.withColumn("checks", F.array(F.lit(default), F.lit(general)))
    parts = F.coalesce(F.map_entries("contributions"), F.array().cast("array<struct<key:string,value:double>>"))
    t = t.withColumns({"s": F.coalesce("s", F.expr("filter(array(named_struct('first_us', 0L, 'stage_order', 0, 'stage', '', 'label', '', 'n_alerts', 0L, 'alert_types', array(''), 'last_us', 0L, 'alert_ids', array(''))), x -> false)")), "largest": F.reverse(F.array_sort(F.transform(parts, lambda x: F.struct(x["value"].alias("v"), F.translate(x["key"], "_", " ").alias("k")))))})
    chain = F.when(F.size("s") > 0, F.array_join(F.col("s.label"), " -> ")).otherwise("no stage of an attack")
    drivers = F.array_join(F.transform(F.slice("largest", 1, 3), lambda x: F.format_string("%s %.0f", x["k"], x["v"])), ", ")
    text = F.format_string("%s: %d alerts, %s to %s, correlated with confidence %.2f. Stages: %s. Risk %.0f of 100, %s; most points: %s.", "title", "n_alerts", time("first_us"), time("last_us"), "correlation_confidence", chain, "risk_score", "severity", drivers)
    fact = lambda words, ids: F.struct(words.alias("fact"), F.slice(ids, 1, CITED).alias("alert_ids"))
    ids = F.coalesce("alert_ids", F.array().cast("array<string>"))
    none = F.array().cast(_NO_FACTS)
    from_stages = F.transform("s", lambda x: fact(F.format_string("%s: %d alerts of %s, %s to %s", x["label"], x["n_alerts"], F.array_join(x["alert_types"], ", "), time(x["first_us"]), time(x["last_us"])), x["alert_ids"]))
    from_maps = F.coalesce(F.transform(F.slice("m", 1, FROM_TECHNIQUES), lambda x: fact(F.format_string("%s: %s (%s)", x["technique_id"], x["reason"], x["name"]), x["evidence"])), none)
    kinds = F.array_join(F.transform(F.slice("top_alert_types", 1, 4), lambda x: F.format_string("%d x %s", x["n"], x["alert_type"])), ", ")
    found = F.concat(from_stages, from_maps)
    found = F.when(F.size(found) > 0, found).otherwise(F.array(fact(F.format_string("%d alerts: %s", "n_alerts", F.coalesce(kinds, F.lit("no types"))), ids)))
    from_notes = F.coalesce(F.transform(F.slice("anomaly_notes", 1, FROM_NOTES), lambda x: F.struct(F.concat(F.lit("unusual: "), x).alias("fact"), F.slice(ids, 1, 3).alias("alert_ids"))), none)
    has = lambda *x: F.arrays_overlap(F.col("s.stage"), F.array(*[F.lit(v) for v in x]))
    chained, odd = F.coalesce("chain_strength", F.lit(0.0)), F.coalesce("anomaly_score", F.lit(0.0))
    guess = lambda when, words, sure: F.when(when, F.struct(words.alias("hypothesis"), F.round(sure, 2).cast("double").alias("confidence")))
    abused, acted = has("credential_attack") & has("valid_access"), has("execution", "privilege_persistence", "credential_theft")
    hypotheses = F.array_compact(
        F.array(
            guess(abused, F.concat(F.lit("Someone else guessed or took over the credentials of "), user), F.least(F.lit(0.9), 0.5 + 0.4 * chained)),
            guess(acted, F.lit("A person acts on the systems after access; this is no false alarm of automation"), F.least(F.lit(0.85), 0.3 + 0.5 * odd)),
            guess(~(abused | acted) | (chained < 0.3), F.lit("Routine or authorised activity: few steps of an attack are to be seen"), F.greatest(F.lit(0.1), 1 - chained - odd / 2)),
        )
    )
    why = F.transform(F.slice("largest", 1, 4), lambda x: F.format_string("%s: %.1f of %.0f points", x["k"], x["v"], F.col("risk_score")))
    unsure = F.array_compact(F.array(F.lit("Made from records by fixed rules"), F.lit("Alerts alone do not show who acted, or why"), F.when(F.col("correlation_confidence") < 0.5, "Weak correlation: some of the alerts may not belong here")))
    sure = F.coalesce(F.aggregate(F.col("m.confidence"), F.lit(0.0), lambda a, x: a + x) / F.size("m"), F.lit(0.3))
    return t.select(
        "incident_id", text.alias("summary"), F.slice(F.concat(found, from_notes), 1, MAX_FACTS).alias("facts"), hypotheses.alias("hypotheses"), why.alias("why"), "affected",
        F.coalesce(F.transform("m", lambda x: F.struct(x["technique_id"].alias("technique_id"), x["name"].alias("name"), x["reason"].alias("reason"))), F.array().cast("array<struct<technique_id:string,name:string,reason:string>>")).alias("techniques"),
        "checks", unsure.alias("uncertainties"), F.round(0.5 * F.col("correlation_confidence") + 0.5 * sure, 2).alias("overall_confidence"),
    )


#: Characters of a summary and a claim, and claims of a kind, that a brief from outside may have.
LONGEST_SUMMARY, LONGEST_CLAIM, MOST_CLAIMS = 3000, 600, 12


def within_limits(briefs: DataFrame) -> DataFrame:
    """briefs with schema_valid: a summary, texts within their lengths, no more claims than allowed, and confidences from 0 to 1.

    briefs: summary, facts (fact, alert_ids), hypotheses (hypothesis, confidence), overall_confidence.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    short = lambda x: F.char_length(F.coalesce(x, F.lit(""))).between(1, LONGEST_CLAIM)
    sure = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    ok = F.char_length(F.coalesce("summary", F.lit(""))).between(1, LONGEST_SUMMARY) & (size("facts") <= MOST_CLAIMS) & (size("hypotheses") <= MOST_CLAIMS) & sure(F.col("overall_confidence"))
    ok = ok & F.coalesce(F.forall("facts", lambda f: short(f["fact"])), F.lit(True)) & F.coalesce(F.forall("hypotheses", lambda h: short(h["hypothesis"]) & sure(h["confidence"])), F.lit(True))
    return briefs.withColumn("schema_valid", ok)
