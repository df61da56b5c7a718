"""Readers of raw alerts, contexts, ground truth, technique bundles and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_FIELDS = [
    "alert_id", "timestamp", "source", "vendor", "alert_type", "title", "severity", "severity_score", "confidence", "user", "host", "src_ip", "dst_ip",
    "process", "resource", "asset_criticality", "user_privilege", "raw_event_ref",
]


def typed(rows: DataFrame, body: str = "body") -> DataFrame:
    """Raw alert columns (text) of a column of JSON texts; attributes stay JSON; has_confidence: whether the key is there.

    A text that is no JSON object has every field null and parse_error says so; it is rejected downstream.
    """
    keys = F.json_object_keys(body)
    cols = [F.get_json_object(body, f"$.{c}").alias(c) for c in RAW_FIELDS]
    bad = keys.isNull()
    return rows.select(*[c for c in rows.columns if c != body], *cols, F.get_json_object(body, "$.attributes").alias("attributes"), F.coalesce(F.array_contains(keys, "confidence"), F.lit(False)).alias("has_confidence"), F.when(bad, F.lit("not a JSON object")).alias("parse_error"), F.col(body).alias("raw"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One alert a line; blank lines are skipped, bad lines kept with parse_error. pos grows with file and line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return typed(lines.select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("body")))


def json_rows(text: Column) -> Column:
    """The rows of one JSON document as an array of JSON texts: a list, or its member alerts, else value; a query response's tables are zipped by column names, the shorter side counting."""
    variant = F.try_parse_json(text)
    rows = F.coalesce(F.try_variant_get(variant, "$", "array<variant>"), F.try_variant_get(variant, "$.alerts", "array<variant>"), F.try_variant_get(variant, "$.value", "array<variant>"))
    plain = F.transform(rows, lambda v: F.to_json(v))
    tables = F.from_json(text, "struct<tables:array<struct<columns:array<struct<name:string>>,rows:array<array<string>>>>>").getField("tables")

    def one(t: Column) -> Column:
        names = F.transform(t["columns"], lambda c: c["name"])

        def zipped(r: Column) -> Column:
            n = F.least(F.size(names), F.size(r))
            return F.to_json(F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(r, F.lit(1), n)))

        return F.transform(t["rows"], zipped)

    return F.when(tables.isNotNull(), F.flatten(F.transform(tables, one))).otherwise(plain)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, each a JSON document. pos grows with the row inside a file, and differs between files (their numbers stand above the lowest 31 bits)."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    order = Window.orderBy("file")  # a row for each file
    numbers = files.select("file").distinct().select("file", (F.row_number().over(order) - 1).cast("long").alias("number"))
    rows = files.select("file", F.posexplode(json_rows(F.col("value"))).alias("at", "body"))
    return typed(rows.join(F.broadcast(numbers), "file").select((F.shiftleft("number", 31) + F.col("at")).alias("pos"), "body"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header; empty cells are null; attributes that are no JSON object become {"raw": cell}."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="")
    have = [c for c in RAW_FIELDS if c in rows.columns]
    cell = F.col("attributes") if "attributes" in rows.columns else F.lit(None).cast("string")
    attributes = F.when(cell.isNotNull(), F.when(F.json_object_keys(cell).isNotNull(), cell).otherwise(F.to_json(F.create_map(F.lit("raw"), cell))))
    return rows.select(F.monotonically_increasing_id().alias("pos"), *[F.col(c).alias(c) for c in have], attributes.alias("attributes"), F.lit("confidence" in have).alias("has_confidence"))


def read_technique_bundle(spark: SparkSession, path: str, source: str = "mitre-attack") -> tuple[DataFrame, DataFrame]:
    """techniques (technique_id, name, tactics, description, version) and tactics (short, name) of a STIX bundle.

    Revoked and deprecated objects and those without an official id are left out; a sub-technique's name has
    its parent's before it; a description is its first line, 600 characters at most.
    """
    schema = "struct<objects:array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_shortname:string,x_mitre_version:string,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>>"
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema).getField("objects")).alias("o")).select("o.*")
    alive = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    tactics = objects.filter((F.col("type") == "x-mitre-tactic") & ~F.coalesce("revoked", F.lit(False))).select(F.col("x_mitre_shortname").alias("short"), "name")
    t = objects.filter((F.col("type") == "attack-pattern") & alive).withColumn("technique_id", F.get(F.transform(F.filter("external_references", lambda r: r["source_name"] == source), lambda r: r["external_id"]), F.lit(0))).filter("technique_id is not null")
    phases = F.transform(F.filter(F.coalesce("kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"] == source), lambda p: p["phase_name"])
    t = t.select("technique_id", "name", phases.alias("tactics"), F.substring(F.split(F.coalesce("description", F.lit("")), "\n")[0], 1, 600).alias("description"))
    parents = t.select(F.col("technique_id").alias("_parent"), F.col("name").alias("_name"))
    t = t.withColumn("_parent", F.when(F.col("technique_id").contains("."), F.substring_index("technique_id", ".", 1))).join(parents, "_parent", "left")
    version = objects.filter("type = 'x-mitre-collection'").agg(F.max("x_mitre_version").alias("version"))
    t = t.select("technique_id", F.when(F.col("_name").isNotNull(), F.concat("_name", F.lit(": "), "name")).otherwise(F.col("name")).alias("name"), "tactics", "description").crossJoin(F.broadcast(version))
    return t, tactics


def tactic_names(techniques: DataFrame, tactics: DataFrame) -> DataFrame:
    """technique_id and tactic_names in order; an unknown short name stays as it is."""
    each = techniques.select("technique_id", F.posexplode("tactics").alias("at", "short")).join(tactics.withColumnRenamed("name", "_name"), "short", "left")
    return each.groupBy("technique_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("_name", "short").alias("name")))).getField("name").alias("tactic_names"))


def read_context(spark: SparkSession, users_path: str, assets_path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """users, hosts, resources and ip_to_host of a directory and an inventory, JSON objects keyed by name. Names are folded."""
    user = "map<string,struct<department:string,privilege:int,is_service:boolean,baseline_hours:array<int>,normal_hosts:array<string>,known_src_ips:array<string>,known_processes:array<string>>>"
    asset = "struct<hosts:map<string,struct<ip:string,criticality:int,environment:string,role:string,owner:string>>,resources:map<string,struct<criticality:int,environment:string,owner:string>>>"
    u = spark.read.text(users_path, wholetext=True).select(F.explode(F.from_json("value", f"struct<users:{user}>").getField("users")).alias("user", "v"))
    users = u.select(F.lower("user").alias("user"), "v.*", F.get("v.baseline_hours", F.lit(0)).alias("hours_from"), F.get("v.baseline_hours", F.lit(1)).alias("hours_to"))
    a = spark.read.text(assets_path, wholetext=True).select(F.from_json("value", asset).alias("a"))
    hosts = a.select(F.explode("a.hosts").alias("host", "v")).select(F.upper("host").alias("host"), "v.*")
    resources = a.select(F.explode("a.resources").alias("resource", "v")).select(F.lower("resource").alias("resource"), "v.*")
    return users, hosts, resources, ip_to_host(hosts)


def ip_to_host(hosts: DataFrame) -> DataFrame:
    """ip and host, one host (the smallest name) for each address."""
    return hosts.filter("ip is not null").groupBy("ip").agg(F.min("host").alias("host"))


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """truth (alert_id, gt_id) and truth_incidents (gt_id, scenario, malicious, priority)."""
    schema = "struct<alerts:map<string,string>,incidents:map<string,struct<scenario:string,malicious:boolean,priority:string,story:string,mitre:array<string>,stage_order:array<string>>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return d.select(F.explode("d.alerts").alias("alert_id", "gt_id")), d.select(F.explode("d.incidents").alias("gt_id", "v")).select("gt_id", "v.*")


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """decisions (evidence_hash, model, status, response) and briefs (evidence_hash, prompt_version, provider, status, output)."""
    schema = "struct<decisions:array<struct<evidence_hash:string,model:string,status:string,response:string>>,briefs:array<struct<evidence_hash:string,prompt_version:string,provider:string,status:string,output:string>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return d.select(F.explode("d.decisions").alias("x")).select("x.*"), d.select(F.explode("d.briefs").alias("x")).select("x.*")


def decision_answers(decisions: DataFrame, body: str = "response", levels: int = 5) -> DataFrame:
    """decisions with p_malicious, severity_normalized, p_escalate, disposition_confidence and needs_review from nested answers."""
    g = lambda path: F.get_json_object(body, path).try_cast("double")
    return decisions.withColumns(
        {
            "p_malicious": F.round(g("$.malicious.probability"), 4), "severity_normalized": F.round((g("$.severity.level") - 1) / (levels - 1), 4), "p_escalate": F.round(g("$.escalate.probability"), 4),
            "disposition_confidence": F.round(g("$.disposition.confidence"), 4), "needs_review": F.coalesce(F.get_json_object(body, "$.disposition.uncertain") == "true", F.lit(False)) | (g("$.disposition.confidence") < 0.55),
        }
    )
