"""A vendor's alert rows to raw alerts and back, and incidents as the vendor's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import catalog, normalize

MARKERS = ["SystemAlertId", "AlertName", "AlertSeverity"]
_FIELDS = ["TimeGenerated", "StartTime", "SystemAlertId", "AlertName", "AlertType", "AlertSeverity", "ProductName", "Description", "ConfidenceScore", "Entities", "ExtendedProperties", "Techniques", "SubTechniques"]
_ENTITY = "array<struct<`$id`:string,Type:string,Name:string,UPNSuffix:string,HostName:string,NetBiosName:string,DnsDomain:string,Address:string,CommandLine:string,ImageFile:struct<`$ref`:string,Name:string>,Upn:string,MailboxPrimaryAddress:string,ResourceId:string,AppName:string>>"

# --- fixed values: results depend on them -------------------------------------------------------------
ALERT_NAMES = {
    "failed_login": "Failed sign-in attempt", "account_lockout": "Account locked after failed sign-in attempts", "login_success": "Sign-in activity",
    "login_success_after_failures": "Successful sign-in after multiple failed attempts", "login_new_source": "Sign-in from an unusual location", "new_device_login": "Unfamiliar sign-in properties",
    "impossible_travel": "Impossible travel activity", "mfa_fatigue": "MFA push notification fatigue", "password_spray_detected": "Password spray attack",
    "powershell_execution": "Suspicious PowerShell command line", "encoded_command": "Suspicious encoded PowerShell command", "script_execution": "Suspicious script interpreter activity",
    "office_spawn_shell": "Office application spawned a child process", "phishing_attachment_opened": "Phish delivered and attachment opened", "privilege_group_change": "User added to privileged group",
    "privileged_role_assigned": "Privileged role assigned outside PIM", "account_discovery": "Account enumeration reconnaissance", "scheduled_task_created": "Suspicious scheduled task created",
    "new_service_installed": "Suspicious service installation", "credential_dump": "Credential dump from LSASS memory", "remote_service_login": "Remote desktop logon to server",
    "sensitive_resource_access": "Sensitive data access", "bulk_data_access": "Unusual volume of records read (mass download)", "large_data_transfer": "Possible data exfiltration: unusual volume upload",
    "mailbox_access": "Mail items accessed via API", "port_scan_internal": "Internal port scan detected",
}
PRODUCTS = {
    "identity": "Microsoft Entra ID Protection", "endpoint": "Microsoft Defender for Endpoint", "network": "Microsoft Defender for Endpoint", "data": "Microsoft Defender for Cloud Apps",
    "cloud": "Microsoft Defender for Cloud Apps", "email": "Microsoft Defender for Office 365", "system": "Azure Monitor",
}
REPORTED = {
    "failed_login": "T1110", "password_spray_detected": "T1110", "impossible_travel": "T1078", "powershell_execution": "T1059", "encoded_command": "T1059,T1027",
    "credential_dump": "T1003", "privilege_group_change": "T1098", "account_discovery": "T1087", "large_data_transfer": "T1048",
}
#: types without a name of their own that are exported under their type's id
ROUTINE = [
    "file_share_access", "vpn_connection", "software_install", "service_restart", "patch_installed", "config_change", "firewall_block", "dns_query_suspicious_tld", "usb_device_connected",
    "av_detection_quarantined", "dlp_policy_match", "email_attachment_blocked", "password_change", "admin_script_execution",
]
CLASSIFICATIONS = {"confirmed_malicious": "TruePositive", "false_positive": "FalsePositive", "benign_true_positive": "BenignPositive"}
SEVERITIES = {"critical": "High", "high": "High", "medium": "Medium", "low": "Low"}
TACTICS = {
    "credential-access": "CredentialAccess", "initial-access": "InitialAccess", "execution": "Execution", "persistence": "Persistence", "privilege-escalation": "PrivilegeEscalation", "stealth": "DefenseEvasion",
    "defense-evasion": "DefenseEvasion", "discovery": "Discovery", "lateral-movement": "LateralMovement", "collection": "Collection", "exfiltration": "Exfiltration", "command-and-control": "CommandAndControl", "impact": "Impact",
}
# ------------------------------------------------------------------------------------------------------


def is_vendor_row(raw: Column) -> Column:
    """Whether a JSON text has two of the three marker keys, whatever their values."""
    return F.coalesce(F.size(F.array_intersect(F.json_object_keys(raw), F.array(*[F.lit(m) for m in MARKERS]))) >= 2, F.lit(False))


def from_vendor(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """pos and the columns of a raw alert, from the JSON text of a vendor row."""
    g = lambda k: F.col(f"j.{k}")
    of = lambda kind: F.filter("e", lambda x: F.lower(x["Type"]) == kind)
    parsed = rows.select(*[c for c in rows.columns if c in ("pos", raw)], F.from_json(raw, ", ".join(f"{c} string" for c in _FIELDS)).alias("j"))
    t = parsed.withColumn("e", F.coalesce(F.from_json(F.col("j.Entities"), _ENTITY), F.array().cast(_ENTITY)))
    proc = F.filter("e", lambda x: (F.lower(x["Type"]) == "process") & (x["CommandLine"].isNotNull() | x["ImageFile"].isNotNull()))
    files = F.map_from_entries(F.transform(F.filter("e", lambda x: (F.lower(x["Type"]) == "file") & x["$id"].isNotNull() & x["Name"].isNotNull()), lambda x: F.struct(x["$id"], x["Name"])))
    account, host, mailbox = (F.get(of(k), F.lit(0)) for k in ("account", "host", "mailbox"))
    held = lambda x: F.when((F.lower(x["Type"]) == "mailbox") & x["MailboxPrimaryAddress"].isNotNull(), F.concat(F.lit("mailbox:"), F.substring_index(x["MailboxPrimaryAddress"], "@", 1))).when(
        F.lower(x["Type"]).isin("cloud-application", "azure-resource"), F.lower(F.substring_index(F.coalesce(x["Name"], x["ResourceId"]), "/", -1))
    )
    resource = F.get(F.array_compact(F.transform("e", held)), F.lit(0))
    ips = F.transform(of("ip"), lambda x: x["Address"])
    p = F.get(proc, F.lit(0))
    image = F.coalesce(p["ImageFile"]["Name"], F.element_at(files, p["ImageFile"]["$ref"]))
    user = F.coalesce(F.when(account["Name"].isNotNull() & account["UPNSuffix"].isNotNull(), F.concat_ws("@", account["Name"], account["UPNSuffix"])), account["Name"], mailbox["Upn"])
    extended = F.coalesce(F.from_json(g("ExtendedProperties"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    command = F.create_map(F.lit("command_line"), p["CommandLine"])
    techniques = F.create_map(F.lit("vendor_techniques"), F.array_join(normalize.valid_techniques(F.concat_ws(",", g("Techniques"), g("SubTechniques"))), ","))
    attributes = F.map_filter(F.map_concat(F.map_filter(command, lambda k, v: ~F.map_contains_key(extended, "command_line")), F.map_filter(extended, lambda k, v: k != "vendor_techniques"), techniques), lambda k, v: v.isNotNull() & (v != ""))
    return t.select(
        *[c for c in ("pos",) if c in rows.columns], g("SystemAlertId").alias("alert_id"), F.coalesce(g("StartTime"), g("TimeGenerated")).alias("timestamp"), normalize.product_source(g("ProductName")).alias("source"),
        F.coalesce(g("ProductName"), F.lit("Microsoft Sentinel")).alias("vendor"), normalize.classify(g("AlertName"), g("AlertType"), g("Description")).alias("alert_type"), g("AlertName").alias("title"),
        F.lower(g("AlertSeverity")).alias("severity"), F.lit(None).cast("string").alias("severity_score"), F.coalesce(g("ConfidenceScore"), F.lit("0.7")).alias("confidence"), user.alias("user"),
        F.coalesce(host["HostName"], host["NetBiosName"]).alias("host"), F.get(ips, F.lit(0)).alias("src_ip"), F.get(ips, F.lit(1)).alias("dst_ip"), image.alias("process"),
        resource.alias("resource"), F.to_json(attributes).alias("attributes"), F.lit(True).alias("has_confidence"), F.col(raw).alias("raw"),
    )


def convert(rows: DataFrame) -> DataFrame:
    """Rows of typed(): vendor rows converted, the others as they are; converted says which."""
    flagged = rows.withColumn("converted", is_vendor_row(F.col("raw")))
    other = flagged.filter("not converted")
    new = from_vendor(flagged.filter("converted")).withColumn("converted", F.lit(True))
    return other.unionByName(new, allowMissingColumns=True)


def to_vendor(alerts: DataFrame) -> DataFrame:
    """pos and raw, the alert as a vendor row's JSON text.

    Types with a vendor name have an empty AlertType, so that reading them back goes by keywords; routine types
    keep their type's id. Other alerts (an unknown type, or none) pass as they are. domain\\user and user@domain
    are one account; mailbox: resources are mailboxes, others applications.
    """
    c = F.col
    named, kind = catalog.lookup(c("alert_type"), ALERT_NAMES), c("alert_type")
    known = named.isNotNull() | kind.isin(ROUTINE)
    ent = lambda when, **kv: F.when(when, F.struct(*[(kv[k] if k in kv else F.lit(None).cast(t)).alias(k) for k, t in _OUT]))
    lit = F.lit
    mailbox = c("resource").startswith("mailbox:")
    command = F.get_json_object("attributes", "$.command_line")
    found = F.array_compact(
        F.array(
            ent(c("user").isNotNull(), Type=lit("account"), Name=F.regexp_replace(F.regexp_replace("user", r"^.*\\\\", ""), "@.*$", ""), UPNSuffix=lit("corp.example")),
            ent(c("host").isNotNull(), Type=lit("host"), HostName=F.substring_index("host", ".", 1), DnsDomain=lit("corp.local")),
            ent(c("src_ip").isNotNull(), Type=lit("ip"), Address=c("src_ip")), ent(c("dst_ip").isNotNull(), Type=lit("ip"), Address=c("dst_ip")),
            ent(c("process").isNotNull(), Type=lit("file"), Name=c("process")), ent(c("process").isNotNull(), Type=lit("process"), CommandLine=command, ImageFile=F.struct(lit(0).alias("x"))),
            ent(mailbox, Type=lit("mailbox"), MailboxPrimaryAddress=F.concat(F.substring_index("resource", ":", -1), lit("@corp.example"))),
            ent(c("resource").isNotNull() & ~mailbox, Type=lit("cloud-application"), Name=c("resource")),
        )
    )
    # ids count from 2; a process names the file right before it
    number = lambda i: i.cast("string")
    entities = F.transform(found, lambda x, i: F.struct(number(i + 2).alias("$id"), *[x[k] for k, _ in _OUT if k != "ImageFile"], F.when(x["ImageFile"].isNotNull(), F.struct(number(i + 1).alias("$ref"))).alias("ImageFile")))
    severity = F.when(c("severity") == "critical", "High").otherwise(F.initcap(F.coalesce("severity", lit("medium"))))
    title = F.coalesce(named, c("title"), kind)
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    more = F.to_json(F.map_filter(F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != "command_line"))
    row = F.to_json(
        F.struct(
            time.alias("TimeGenerated"), time.alias("StartTime"), time.alias("EndTime"), c("alert_id").alias("SystemAlertId"), title.alias("AlertName"), F.when(named.isNotNull(), "").otherwise(kind).alias("AlertType"),
            severity.alias("AlertSeverity"), title.alias("Description"), F.coalesce(catalog.lookup(c("source"), PRODUCTS), lit("Microsoft Sentinel")).alias("ProductName"), c("confidence").cast("string").alias("ConfidenceScore"),
            F.coalesce("user", "host").alias("CompromisedEntity"), F.to_json(entities).alias("Entities"), more.alias("ExtendedProperties"), F.to_json(F.split(F.coalesce(catalog.lookup(kind, REPORTED), lit("")), ",")).alias("Techniques"),
        )
    )
    own = [x for x in alerts.columns if x != "pos"]
    plain = F.to_json(F.struct(*[c(x) for x in own if x not in ("ts", "us")], time.alias("timestamp")))
    return alerts.select("pos", F.when(known, row).otherwise(plain).alias("raw"))


_OUT = [("Type", "string"), ("Name", "string"), ("UPNSuffix", "string"), ("HostName", "string"), ("DnsDomain", "string"), ("Address", "string"), ("CommandLine", "string"), ("ImageFile", "struct<x:int>"), ("MailboxPrimaryAddress", "string")]


def incident_documents(incidents: DataFrame, mappings: DataFrame, entities: DataFrame, summaries: DataFrame, provider: str = "alertmill") -> DataFrame:
    """incident_id and document, the JSON text of an incident for the vendor.

    Status: Closed if the incident's status is closed, Active if it has a verdict, else New. The comment is the
    summary and up to six facts with up to three of the alerts they cite, 30000 characters at most.
    incidents: incident_id, title, severity, first_us, last_us, n_alerts, alert_ids, risk_score, contributions, and
    verdict and status, if any; entities: the primary ones; summaries: incident_id, summary, facts (fact, alert_ids).
    """
    m = mappings.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", "technique_id", "tactics"))).alias("m"))
    e = entities.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", "type", "value"))).alias("e"))
    t = incidents.join(m, "incident_id", "left").join(e, "incident_id", "left").join(summaries.select("incident_id", "summary", "facts"), "incident_id", "left")
    none = F.lit(None).cast("string")
    verdict, status = (F.col(c) if c in incidents.columns else none for c in ("verdict", "status"))
    kind = catalog.lookup(verdict, CLASSIFICATIONS)
    state = F.when(status == "closed", "Closed").when(verdict.isNotNull(), "Active").otherwise("New")
    names = F.transform(F.flatten(F.col("m.tactics")), lambda x: F.coalesce(catalog.lookup(x, TACTICS), x))
    summary = F.coalesce("summary", "title")
    cited = F.transform(F.slice(F.coalesce("facts", F.array().cast("array<struct<fact:string,alert_ids:array<string>>>")), 1, 6), lambda f: F.concat(F.lit("- "), f["fact"], F.lit(" ["), F.array_join(F.slice(f["alert_ids"], 1, 3), ", "), F.lit("]")))
    comment = F.substring(F.concat(summary, F.lit("\n\nObserved facts:\n"), F.array_join(cited, "\n")), 1, 30000)
    label = lambda x: F.struct(x.alias("labelName"), F.lit("User").alias("labelType"))
    techniques = F.coalesce(F.col("m.technique_id"), F.array().cast("array<string>"))
    labels = F.transform(F.concat(F.array(F.lit(provider), F.concat(F.lit("risk:"), F.round("risk_score").cast("int").cast("string"))), F.slice(techniques, 1, 10)), label)
    time = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    known = F.filter("e", lambda x: x["type"].isin(list(_ENTITIES)))
    shown = F.transform(known, lambda x: F.struct(catalog.lookup(x["type"], {k: v[0] for k, v in _ENTITIES.items()}).alias("kind"), F.struct(*[F.when(x["type"] == k, x["value"]).alias(v[1]) for k, v in _ENTITIES.items()], x["value"].alias("friendlyName")).alias("properties")))
    properties = F.struct(
        F.col("title"), summary.alias("description"), F.coalesce(catalog.lookup(F.col("severity"), SEVERITIES), F.lit("Informational")).alias("severity"), state.alias("status"), time("first_us").alias("firstActivityTimeUtc"),
        time("last_us").alias("lastActivityTimeUtc"), F.lit(provider).alias("providerName"), F.col("incident_id").alias("providerIncidentId"), labels.alias("labels"),
        F.struct(F.col("n_alerts").alias("alertsCount"), F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))).alias("tactics"), techniques.alias("techniques"), F.array(F.lit(provider)).alias("alertProductNames")).alias("additionalData"),
        kind.alias("classification"), F.when(kind.isNotNull(), F.lit(f"Verdict of an analyst, recorded in {provider}")).alias("classificationComment"),
    )
    document = F.struct(
        properties.alias("properties"), F.col("alert_ids").alias("relatedAlertIds"), shown.alias("entities"),
        F.array(F.struct(F.struct(comment.alias("message")).alias("properties"))).alias("comments"), F.col("contributions").alias("riskBreakdown"),
    )
    return t.select("incident_id", F.to_json(document).alias("document"))


#: kind and name of an entity of a document
_ENTITIES = {"user": ("Account", "accountName"), "host": ("Host", "hostName"), "ip": ("Ip", "address"), "process": ("File", "fileName"), "resource": ("CloudApplication", "appName")}
