"""Techniques of incidents from rules over their alerts, in one aggregation of many conditions.

members: incident_id, pos, us, alert_id, alert_type, user, src_ip, src_ip_private, dst_ip, process, resource,
vendor, attributes (JSON text). A rule gives a technique, a confidence, the evidence and a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import catalog, normalize


@dataclass(frozen=True)
class Rule:
    """where picks the evidence; when looks at the incident's counts (n: pieces of evidence); both are Columns."""

    technique: str
    where: Column
    confidence: Callable[[Column], Column]
    reason: Callable[[Column], Column]
    least: int = 1
    unless: str | None = None  # a technique of an earlier rule that replaces this one


def _is(*types: str) -> Column:
    return F.col("alert_type").isin(*types)


def _command() -> Column:
    return F.lower(F.coalesce(F.get_json_object("attributes", "$.command_line"), F.lit("")))


def _fixed(x: float) -> Callable[[Column], Column]:
    return lambda n: F.lit(x)


def _say(text: str) -> Callable[[Column], Column]:
    return lambda n: F.format_string(text, n) if "%d" in text else F.lit(text)


def default_rules() -> list[Rule]:
    """The rules whose evidence is a choice of an incident's alerts, in order of precedence."""
    shell = _is("powershell_execution", "encoded_command") & (F.col("process").isNull() | F.col("process").isin("powershell.exe", "pwsh.exe") | _command().contains("powershell"))
    share = F.get_json_object("attributes", "$.share").isNotNull() & (F.get_json_object("attributes", "$.share") != "")
    data = _is("sensitive_resource_access", "bulk_data_access")
    rdp = F.upper(F.coalesce(F.get_json_object("attributes", "$.logon_type"), F.lit(""))) == "RDP"
    return [
        Rule("T1059.001", shell, lambda n: F.least(F.lit(0.95), 0.6 + 0.02 * n), _say("PowerShell ran %d times")),
        Rule("T1027", _is("encoded_command"), _fixed(0.8), _say("%d command lines were encoded")),
        Rule("T1059", _is("script_execution"), _fixed(0.7), _say("script interpreters ran %d times")),
        Rule("T1204.002", _is("office_spawn_shell"), _fixed(0.85), _say("a shell was started by an Office program")),
        Rule("T1566.001", _is("phishing_attachment_opened"), _fixed(0.75), _say("a user opened an attachment that was flagged")),
        Rule("T1105", _is("suspicious_process") & _command().contains("urlcache"), _fixed(0.85), _say("certutil fetched a file from elsewhere")),
        Rule("T1003.001", _is("credential_dump") | (_is("suspicious_process") & (_command().contains("minidump") | _command().contains("lsass"))), _fixed(0.9), _say("the memory of LSASS was read or dumped")),
        Rule("T1098.007", _is("privilege_group_change"), _fixed(0.85), _say("users were added to privileged groups %d times")),
        Rule("T1098", _is("privileged_role_assigned"), _fixed(0.8), _say("privileged roles were assigned %d times")),
        Rule("T1543.003", _is("new_service_installed"), _fixed(0.75), _say("%d services were installed")),
        Rule("T1053.005", _is("scheduled_task_created"), _fixed(0.7), _say("%d tasks were scheduled")),
        Rule("T1087.002", _is("account_discovery") & _command().contains("/domain"), _fixed(0.85), _say("commands that list accounts or groups of the domain")),
        Rule("T1087", _is("account_discovery"), _fixed(0.7), _say("accounts were listed"), unless="T1087.002"),
        Rule("T1046", _is("port_scan_internal"), _fixed(0.6), _say("internal port scans were seen %d times")),
        Rule("T1021.001", _is("remote_service_login") & rdp, _fixed(0.8), _say("%d remote desktop sessions on servers")),
        Rule("T1021", _is("remote_service_login"), _fixed(0.7), _say("%d remote sessions"), unless="T1021.001"),
        Rule("T1213", data & ~F.coalesce(share, F.lit(False)), lambda n: F.least(F.lit(0.9), 0.6 + 0.01 * n), _say("a sensitive resource was read %d times")),
        Rule("T1039", data & F.coalesce(share, F.lit(False)), _fixed(0.8), _say("a network share was read in bulk %d times")),
        Rule("T1114.002", _is("mailbox_access"), _fixed(0.75), _say("mailboxes were read through an API %d times"), least=10),
        Rule("T1048", _is("large_data_transfer"), _fixed(0.8), _say("%d outbound transfers were unusually large")),
        Rule("T1621", _is("mfa_fatigue"), _fixed(0.85), _say("%d push requests in a row"), least=5),
    ]


_EVIDENCE = "array<struct<us:bigint,pos:bigint,alert_id:string>>"


def _ids(evidence: Column) -> Column:
    return F.array_sort(evidence).getField("alert_id")


def _collected(where: Column) -> Column:
    return F.collect_list(F.when(where, F.struct("us", "pos", "alert_id")))


#: Alerts that sign_in_rules() looks at.
_SIGN_INS = ["failed_login", "brute_force_detected", "password_spray_detected", "login_new_source", "impossible_travel", "login_success_after_failures", "new_device_login"]


def sign_in_rules(members: DataFrame, evidence: bool = True) -> DataFrame:
    """Brute force, spraying and valid accounts: incident_id, technique_id, confidence, rule, and, if asked for, evidence (alert ids in time order) and reason.

    The failures of an incident are summed by source and by user first.
    """
    members = members.filter(_is(*_SIGN_INS))
    fails = members.filter(_is("failed_login"))
    by_source = fails.filter("src_ip is not null").groupBy("incident_id", "src_ip").agg(
        F.count_distinct("user").alias("users"), F.min(F.when(F.col("user").isNotNull(), F.struct("us", "pos"))).alias("at"), F.count(F.lit(1)).alias("n")
    )
    source = by_source.filter("users >= 10").groupBy("incident_id").agg(F.min_by(F.struct("src_ip", "users", "n"), "at").alias("spray"))
    by_user = fails.filter("user is not null").groupBy("incident_id", "user").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("us", "pos")).alias("at"))
    most = by_user.groupBy("incident_id").agg(F.max_by(F.struct("user", "n"), F.struct("n", -F.col("at.us"), -F.col("at.pos"))).alias("most"))
    detected, sprayed = _is("brute_force_detected"), _is("password_spray_detected")
    external = _is("login_new_source") & ~F.col("src_ip_private") & ~F.col("src_ip").startswith("100.")
    counts = [
        F.count_if(detected).alias("n_detected"), F.count_if(sprayed).alias("n_sprayed"), F.count_if(_is("impossible_travel")).alias("n_travel"),
        F.count_if(_is("login_success_after_failures", "new_device_login")).alias("n_strong"), F.count_if(_is("login_success_after_failures")).alias("n_after"), F.count_if(external).alias("n_external"),
    ]
    if evidence:
        wide = members.join(source, "incident_id", "left").join(most, "incident_id", "left")
        sums = wide.groupBy("incident_id").agg(
            F.first("spray").alias("spray"), F.first("most").alias("most"), *counts, F.count_if(_is("failed_login")).alias("n_fails"),
            F.min_by("src_ip", F.when(sprayed, F.struct("us", "pos"))).alias("sprayed_from"), _collected(detected | _is("failed_login")).alias("e_brute"),
            _collected((_is("failed_login") & (F.col("src_ip") == F.col("spray.src_ip"))) | sprayed).alias("e_spray"), _collected(_is("failed_login") & (F.col("user") == F.col("most.user"))).alias("e_user"),
            _collected(_is("impossible_travel", "login_new_source")).alias("e_travel"), _collected(_is("login_success_after_failures", "new_device_login") | external).alias("e_valid"),
        )
    else:
        sums = members.groupBy("incident_id").agg(*counts).join(source, "incident_id", "left").join(most, "incident_id", "left")
    brute = (F.col("n_detected") > 0) & (F.col("n_sprayed") == 0)
    spray = ~brute & (F.col("spray").isNotNull() | (F.col("n_sprayed") > 0))
    user = ~brute & ~spray & (F.col("most.n") >= 10)
    n = F.coalesce(F.col("spray.n"), F.lit(0)) + F.col("n_sprayed")
    valid = (F.col("n_strong") > 0) | ((F.col("n_external") > 0) & (F.col("n_travel") == 0))

    def made(when: Column, technique: str, confidence: Column, ids: str, reason: Callable[[], Column], rule: int) -> Column:
        told = [_ids(F.col(ids)).alias("evidence"), reason().alias("reason")] if evidence else []
        return F.when(when, F.struct(F.lit(technique).alias("technique_id"), confidence.cast("double").alias("confidence"), *told, F.lit(rule).alias("rule")))

    found = F.array(
        made(brute, "T1110", F.lit(0.85), "e_brute", lambda: F.format_string("a product saw brute force %d times", "n_detected"), 0),
        made(spray, "T1110.003", F.least(F.lit(0.97), 0.7 + 0.002 * n), "e_spray", lambda: F.format_string("%d sign-ins to %d accounts failed from %s", "n_fails", F.coalesce("spray.users", F.lit(0)), F.coalesce("spray.src_ip", "sprayed_from", F.lit("unknown"))), 1),
        made(user, "T1110", F.least(F.lit(0.98), 0.7 + 0.004 * F.col("most.n")), "e_user", lambda: F.format_string("%d sign-ins of %s failed", "most.n", "most.user"), 2),
        made(F.col("n_travel") > 0, "T1078.004", F.lit(0.85), "e_travel", lambda: F.lit("one cloud account signed in from places too far apart"), 3),
        made(valid, "T1078", F.when(F.col("n_after") > 0, 0.9).otherwise(0.65), "e_valid", lambda: F.lit("a sign-in succeeded after failures, or from a source or device not seen before"), 4),
    )
    return sums.select("incident_id", F.explode(F.array_compact(found)).alias("m")).select("incident_id", "m.*")


def behavior_rules(members: DataFrame, rules: list[Rule] | None = None, evidence: bool = True) -> DataFrame:
    """All other rules; columns as of sign_in_rules. An alert goes once to each rule whose evidence it is, and counts and evidence are kept by incident and rule."""
    rules = default_rules() if rules is None else rules
    hits = members.withColumn("_at", F.explode(F.array_compact(F.array(*[F.when(r.where, F.lit(i)) for i, r in enumerate(rules)]))))
    sums = hits.groupBy("incident_id", "_at").agg(F.count(F.lit(1)).alias("n"), *([F.collect_list(F.struct("us", "pos", "alert_id")).alias("e")] if evidence else []))
    place, n, whole = {r.technique: i for i, r in enumerate(rules)}, F.col("n").cast("int"), Window.partitionBy("incident_id")
    if others := sorted({place[r.unless] for r in rules if r.unless}):
        sums = sums.withColumns({f"_has{i}": F.max(F.col("_at") == i).over(whole) for i in others})
    made = []
    for i, r in enumerate(rules):
        told = [_ids(F.col("e")).alias("evidence"), r.reason(n).alias("reason")] if evidence else []
        holds = (F.col("_at") == i) & (n >= r.least) & (~F.col(f"_has{place[r.unless]}") if r.unless else F.lit(True))
        made.append(F.when(holds, F.struct(F.lit(r.technique).alias("technique_id"), r.confidence(n).cast("double").alias("confidence"), *told, F.lit(10 + i).alias("rule"))))
    return sums.select("incident_id", F.coalesce(*made).alias("m")).filter("m is not null").select("incident_id", "m.*")


def vendor_rules(members: DataFrame, evidence: bool = True) -> DataFrame:
    """Techniques that the product itself reported."""
    technique = F.explode(normalize.valid_techniques(F.get_json_object("attributes", "$.vendor_techniques"))).alias("technique_id")
    if not evidence:
        return members.select("incident_id", technique).distinct().select("incident_id", "technique_id", F.lit(0.6).alias("confidence"), F.lit(1000).alias("rule"))
    told = members.select("incident_id", "us", "pos", "alert_id", "vendor", technique)
    out = told.groupBy("incident_id", "technique_id").agg(F.collect_list(F.struct("us", "pos", "alert_id")).alias("e"), F.min_by("vendor", F.struct("us", "pos")).alias("vendor"))
    return out.select("incident_id", "technique_id", F.lit(0.6).alias("confidence"), _ids(F.col("e")).alias("evidence"), F.format_string("%s named it in %d alerts", "vendor", F.size("e")).alias("reason"), F.lit(1000).alias("rule"))


def mapped(members: DataFrame, known: DataFrame | None = None, rules: list[Rule] | None = None, more: list[DataFrame] | None = None, evidence: bool = True) -> DataFrame:
    """incident_id, technique_id, name, tactics, confidence, evidence, reason, place: one row for each technique, the first rule wins.

    known is the technique table; ids that are not in it are dropped. more: outputs of further rules. evidence: without it, evidence
    and reason are left out, and alerts are counted alone, not gathered.
    """
    spark = members.sparkSession
    known = catalog.techniques(spark) if known is None else known
    every = sign_in_rules(members, evidence).unionByName(behavior_rules(members, rules, evidence)).unionByName(vendor_rules(members, evidence))
    for x in more or []:
        every = every.unionByName(x)
    first = F.row_number().over(Window.partitionBy("incident_id", "technique_id").orderBy("rule"))
    kept = every.withColumn("_first", first).filter("_first = 1").join(known.select("technique_id", "name", "tactics"), "technique_id")
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("confidence"), "rule"))
    return kept.withColumn("confidence", F.round("confidence", 3)).withColumn("place", place).select("incident_id", "technique_id", "name", "tactics", "confidence", *(["evidence", "reason"] if evidence else []), "place")
