"""The events table read as alerts, raw alerts, incidents and contexts: input of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import catalog, normalize

_START = 1704067200000000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical alerts: thirty days folded into one; types, hosts, addresses and resources follow from user and k."""
    e = events(spark, sf_dir)
    users = e.agg(F.count_distinct("user_id").alias("n_users"))  # one row
    k, u = F.col("k"), F.col("user_id")
    base = e.crossJoin(F.broadcast(users)).select("event_id", "user_id", "event_type", "value", "n_users", F.get_json_object("props", "$.k").cast("int").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    kind = F.expr(
        "case event_type when 'error' then if(k % 10 = 0, 'account_lockout', 'failed_login') when 'click' then if(k % 10 = 0, 'login_success_after_failures', 'login_success') "
        "when 'view' then if(k % 4 = 0, 'powershell_execution', 'file_share_access') when 'signup' then 'login_new_source' else if(k % 4 = 0, 'bulk_data_access', 'sensitive_resource_access') end"
    )
    src = F.when(k % 3 == 0, F.concat(F.lit("203.0.113."), k)).otherwise(F.concat(F.lit("10.30."), F.expr("user_id div 250"), F.lit("."), u % 250))
    out = base.select(
        F.col("event_id").alias("pos"), F.expr("concat('ALT-', lpad(cast(event_id as string), greatest(8, length(cast(event_id as string))), '0'))").alias("alert_id"),
        (F.lit(_START) + F.expr(f"(t - {_START}) div 30")).alias("us"), kind.alias("alert_type"), F.least(F.lit(100.0), F.col("value") / 5).alias("severity_score"),
        (0.5 + k / 200).alias("confidence"), F.concat(F.lit("user"), u).alias("user"), F.concat(F.lit("HOST-"), u % F.greatest(F.lit(10), F.expr("n_users * 2 div 3"))).alias("host"),
        src.alias("src_ip"), F.lit("10.0.0.53").alias("dst_ip"), F.when(F.col("event_type") == "view", F.concat(F.lit("proc"), k % 6)).alias("process"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("res-"), k % 8)).alias("resource"), "k", "user_id",
    )
    return out.select(
        "pos", "alert_id", F.timestamp_micros("us").alias("ts"), "us", "alert_type", catalog.of_type("title", F.col("alert_type")).alias("title"), catalog.of_type("source", F.col("alert_type")).alias("source"),
        F.lit("unknown").alias("vendor"), normalize.severity_label(F.col("severity_score")).alias("severity"), "severity_score", "confidence", "user", "host", "src_ip", normalize.is_internal_v4(F.col("src_ip")).alias("src_ip_private"),
        "dst_ip", F.lit(True).alias("dst_ip_private"), "process", "resource", F.expr("1 + cast(substring(coalesce(resource, 'res-0'), 5) as int) % 5").alias("asset_criticality"),
        (1 + F.col("user_id") % 5).cast("int").alias("user_privilege"), F.lit("{}").alias("attributes"), F.lit(0).cast("long").alias("duplicate_count"), "k", "user_id",
    )


ALERTS_SQL = """
n_users AS (SELECT count(DISTINCT user_id) AS n FROM events),
alerts_0 AS (
  SELECT event_id AS pos, 'ALT-' || lpad(CAST(event_id AS VARCHAR), greatest(8, length(CAST(event_id AS VARCHAR)))::INT, '0') AS alert_id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 30 AS us,
    CAST(json_extract(props, '$.k') AS INT) AS k, user_id, event_type, value, n FROM events, n_users),
alerts_v AS (
  SELECT pos, alert_id, us, k, user_id,
    CASE event_type WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN 'account_lockout' ELSE 'failed_login' END
      WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'login_success_after_failures' ELSE 'login_success' END
      WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'powershell_execution' ELSE 'file_share_access' END
      WHEN 'signup' THEN 'login_new_source' ELSE CASE WHEN k % 4 = 0 THEN 'bulk_data_access' ELSE 'sensitive_resource_access' END END AS alert_type,
    least(100.0::DOUBLE, value / 5) AS severity_score, 0.5 + k / 200 AS confidence, 'user' || user_id AS "user",
    'HOST-' || (user_id % greatest(10, n * 2 // 3)) AS host,
    CASE WHEN k % 3 = 0 THEN '203.0.113.' || k ELSE '10.30.' || (user_id // 250) || '.' || (user_id % 250) END AS src_ip, k % 3 <> 0 AS src_ip_private,
    '10.0.0.53' AS dst_ip, CASE WHEN event_type = 'view' THEN 'proc' || (k % 6) END AS process, CASE WHEN event_type = 'purchase' THEN 'res-' || (k % 8) END AS resource,
    1 + CAST(CASE WHEN event_type = 'purchase' THEN k % 8 ELSE 0 END AS INT) % 5 AS asset_criticality, 1 + user_id % 5 AS user_privilege,
    CASE WHEN least(100.0, value / 5) >= 85 THEN 'critical' WHEN least(100.0, value / 5) >= 65 THEN 'high' WHEN least(100.0, value / 5) >= 40 THEN 'medium' WHEN least(100.0, value / 5) >= 20 THEN 'low' ELSE 'informational' END AS severity,
    "user_incident" AS incident_id
  FROM (SELECT *, 'user' || user_id || '-' || (((us - 1704067200000000) // 3600000000) // 6) AS "user_incident" FROM alerts_0)),
types_v AS (SELECT * FROM (VALUES @types) AS t(alert_type, source, title, severity, family, stage)),
stages_v AS (SELECT * FROM (VALUES @stages) AS t(stage, label, stage_order)),
sequences_v AS (SELECT * FROM (VALUES @sequences) AS t(first, second))
"""
for _name, _values in (
    ("@types", ", ".join("(" + ", ".join(f"'{x}'" if x else "NULL" for x in r) + ")" for r in catalog.ALERT_TYPES)),
    ("@stages", ", ".join(f"('{s}', '{label}', {i})" for i, (s, label) in enumerate(catalog.STAGES))),
    ("@sequences", ", ".join(f"('{a}', '{b}')" for a, b in catalog.SEQUENCES)),
):
    ALERTS_SQL = ALERTS_SQL.replace(_name, _values)


def with_incidents(df: DataFrame) -> DataFrame:
    """incident_id: the alerts of one user in a quarter of the day."""
    return df.withColumn("incident_id", F.concat("user", F.lit("-"), F.expr(f"((us - {_START}) div 3600000000) div 6")))


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts as they might come in: other spellings, times as text, IPv6, severities by label alone, bad values, copies.

    copy is 0 for an alert, 1 for a copy under another id, 2 for one under the same id; pos sets copies after what they repeat.
    """
    a = alerts(spark, sf_dir)
    k = F.col("k")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = a.select(
        (4 * F.col("pos")).alias("pos"), "alert_id", "k", F.when(k == 99, "not-a-timestamp").when(k % 25 == 0, F.expr("cast(us div 1000 as string)")).otherwise(iso).alias("timestamp"),
        F.when(k != 96, F.col("alert_type")).alias("alert_type"), F.when(k == 94, "Crit").alias("severity"), F.when(k == 98, 500.0).when(k != 94, F.col("severity_score")).alias("severity_score"), "confidence",
        F.when(k % 7 == 0, F.concat(F.lit("CORP\\"), F.upper("user"))).when(k % 7 == 1, F.concat("user", F.lit("@corp.example"))).otherwise(F.col("user")).alias("user"),
        F.when(k % 13 == 0, F.concat(F.lower("host"), F.lit(".corp.local"))).otherwise(F.col("host")).alias("host"),
        F.when(k == 97, "999.10.1.1").when(k == 95, F.concat(F.lit("2001:0DB8:0::"), F.col("user_id") % 9 + 1)).otherwise(F.col("src_ip")).alias("src_ip"), "dst_ip", "process", "resource", F.lit(0).alias("copy"),
    )
    copies = raw.filter("k = 10").withColumns({"pos": F.col("pos") + 1, "alert_id": F.concat("alert_id", F.lit("-DUP")), "copy": F.lit(1)})
    again = raw.filter("k = 11").withColumns({"pos": F.col("pos") + 2, "copy": F.lit(2)})
    return raw.unionByName(copies).unionByName(again).withColumn("attributes", F.lit(None).cast("string"))


RAW_SQL = r"""
raw_0 AS (SELECT 4 * pos AS pos, alert_id, us, k, alert_type, CASE WHEN k = 94 THEN 92 ELSE severity_score END AS severity_score, CASE WHEN k = 94 THEN 'critical' ELSE severity END AS severity, confidence, "user", host,
  CASE WHEN k = 95 THEN '2001:db8::' || (user_id % 9 + 1) WHEN k = 97 THEN '999.10.1.1' ELSE src_ip END AS src_ip, dst_ip, process, resource FROM alerts_v),
raw_1 AS (SELECT * FROM raw_0 UNION ALL SELECT * REPLACE (pos + 1 AS pos, alert_id || '-DUP' AS alert_id) FROM raw_0 WHERE k = 10
  UNION ALL SELECT * REPLACE (pos + 2 AS pos) FROM raw_0 WHERE k = 11),
raw_v AS (SELECT *, k % 25 = 0 AS ms, list_filter([CASE WHEN k = 96 THEN 'missing alert_type' END, CASE WHEN k = 99 THEN 'bad timestamp' END,
  CASE WHEN k = 98 THEN 'severity_score outside 0..100' END, CASE WHEN k = 97 THEN 'bad src_ip' END], lambda x: x IS NOT NULL) AS errors FROM raw_1),
accepted_0 AS (SELECT *, CASE WHEN ms THEN us // 1000 * 1000 ELSE us END AS t, row_number() OVER (PARTITION BY alert_id ORDER BY pos) AS id_place FROM raw_v),
accepted_1 AS (SELECT *, alert_type || '|' || t || '|' || "user" || '|' || host || '|' || src_ip || '|' || dst_ip || '|' || coalesce(process, '-') || '|' || coalesce(resource, '-') AS content
  FROM accepted_0 WHERE id_place = 1 AND len(errors) = 0),
accepted_2 AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY pos) AS content_place, count(*) OVER (PARTITION BY content) - 1 AS copies,
  first_value(alert_id) OVER (PARTITION BY content ORDER BY pos) AS kept FROM accepted_1)
"""


def contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """users, hosts and resources of the alerts."""
    e = alerts(spark, sf_dir)
    users = e.select("user", "user_id").distinct().select(
        "user", (1 + F.col("user_id") % 5).cast("int").alias("privilege"), F.lit(8).alias("hours_from"), F.lit(18).alias("hours_to"),
        F.array(F.concat(F.lit("10.30."), F.expr("user_id div 250"), F.lit("."), F.col("user_id") % 250)).alias("known_src_ips"), F.array(*[F.lit(f"proc{i}") for i in range(3)]).alias("known_processes"),
    )
    n = F.substring("host", 6, 20).cast("int")
    hosts = e.select("host").distinct().select("host", (1 + n % 5).alias("criticality"), F.when(n < 250, F.concat(F.lit("10.30.0."), n)).alias("ip"))
    resources = e.filter("resource is not null").select("resource").distinct().select("resource", (1 + F.substring("resource", 5, 3).cast("int") % 5).alias("criticality"))
    return users, hosts, resources


CONTEXT_SQL = """
users_v AS (SELECT DISTINCT "user", 1 + user_id % 5 AS privilege, '10.30.' || (user_id // 250) || '.' || (user_id % 250) AS known_ip FROM alerts_v),
hosts_v AS (SELECT DISTINCT host, 1 + CAST(substr(host, 6) AS INT) % 5 AS criticality, CASE WHEN CAST(substr(host, 6) AS INT) < 250 THEN '10.30.0.' || substr(host, 6) END AS ip FROM alerts_v),
resources_v AS (SELECT DISTINCT resource, 1 + CAST(substr(resource, 5) AS INT) % 5 AS criticality FROM alerts_v WHERE resource IS NOT NULL)
"""
