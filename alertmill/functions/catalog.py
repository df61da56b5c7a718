"""Fixed tables of alert types, stages, families, severities and techniques, and lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: results depend on them -------------------------------------------------------------

#: alert type, source, title, severity, family, stage
ALERT_TYPES = [
    ("login_success", "identity", "Successful sign-in", "informational", "auth", None),
    ("failed_login", "identity", "Failed authentication", "low", "auth_fail", "credential_attack"),
    ("account_lockout", "identity", "Account locked out", "low", "auth_fail", "credential_attack"),
    ("password_change", "identity", "Password changed", "informational", "account", None),
    ("password_spray_detected", "identity", "Password spray pattern detected", "high", "auth_fail", "credential_attack"),
    ("login_success_after_failures", "identity", "Successful login after repeated failures", "high", "auth", "valid_access"),
    ("login_new_source", "identity", "Sign-in from new source", "medium", "auth", "valid_access"),
    ("new_device_login", "identity", "Sign-in from unfamiliar device", "medium", "auth", "valid_access"),
    ("impossible_travel", "identity", "Impossible travel sign-in", "high", "auth", "valid_access"),
    ("brute_force_detected", "identity", "Brute force attack detected", "high", "auth_fail", "credential_attack"),
    ("sentinel_alert", "sentinel", "Microsoft Sentinel alert", "medium", "other", None),
    ("mfa_fatigue", "identity", "Repeated MFA push requests", "medium", "auth_fail", "credential_attack"),
    ("vpn_connection", "network", "VPN session established", "informational", "auth", None),
    ("privilege_group_change", "identity", "User added to privileged group", "high", "privilege", "privilege_persistence"),
    ("privileged_role_assigned", "identity", "Privileged role assigned", "high", "privilege", "privilege_persistence"),
    ("account_discovery", "endpoint", "Account/group enumeration", "medium", "discovery", "discovery"),
    ("powershell_execution", "endpoint", "PowerShell execution", "medium", "execution", "execution"),
    ("encoded_command", "endpoint", "Encoded PowerShell command", "high", "execution", "execution"),
    ("script_execution", "endpoint", "Script interpreter execution", "medium", "execution", "execution"),
    ("suspicious_process", "endpoint", "Suspicious process behavior", "high", "execution", "execution"),
    ("office_spawn_shell", "endpoint", "Office application spawned a shell", "high", "execution", "execution"),
    ("phishing_attachment_opened", "email", "Suspicious attachment opened", "medium", "email", "initial_access"),
    ("admin_script_execution", "endpoint", "Administrative script execution", "low", "execution", "execution"),
    ("scheduled_task_created", "endpoint", "Scheduled task created", "low", "persistence", "privilege_persistence"),
    ("new_service_installed", "endpoint", "New service installed", "medium", "persistence", "privilege_persistence"),
    ("credential_dump", "endpoint", "Credential dumping behavior (LSASS access)", "critical", "credential_theft", "credential_theft"),
    ("remote_service_login", "network", "Remote desktop logon to server", "medium", "lateral", "lateral_movement"),
    ("av_detection_quarantined", "endpoint", "Potentially unwanted app quarantined", "medium", "malware", None),
    ("usb_device_connected", "endpoint", "USB storage device connected", "low", "device", None),
    ("software_install", "endpoint", "Software installed", "informational", "system", None),
    ("service_restart", "system", "Service restarted", "informational", "system", None),
    ("patch_installed", "system", "Patch installed", "informational", "system", None),
    ("config_change", "system", "Configuration changed", "low", "system", None),
    ("firewall_block", "network", "Outbound connection blocked", "low", "network", None),
    ("dns_query_suspicious_tld", "network", "DNS query to uncommon TLD", "low", "network", None),
    ("port_scan_internal", "network", "Internal port scan detected", "medium", "discovery", "discovery"),
    ("large_data_transfer", "network", "Unusually large outbound transfer", "high", "exfil", "exfiltration"),
    ("file_share_access", "data", "File share accessed", "informational", "data", None),
    ("dlp_policy_match", "data", "DLP policy match", "medium", "data", None),
    ("email_attachment_blocked", "email", "Email attachment blocked", "low", "email", None),
    ("sensitive_resource_access", "data", "Sensitive resource accessed", "medium", "data_access", "resource_access"),
    ("bulk_data_access", "data", "Unusual volume of records read", "high", "data_access", "resource_access"),
    ("mailbox_access", "cloud", "Mailbox accessed via API", "low", "data_access", "resource_access"),
]

#: stage and label, in order
STAGES = [
    ("initial_access", "Initial Access"),
    ("credential_attack", "Credential Attack"),
    ("valid_access", "Valid Account / Access"),
    ("execution", "Execution"),
    ("privilege_persistence", "Privilege / Persistence"),
    ("credential_theft", "Credential Theft"),
    ("discovery", "Discovery"),
    ("lateral_movement", "Lateral Movement"),
    ("resource_access", "Sensitive Resource Access"),
    ("exfiltration", "Exfiltration"),
]

#: families that follow one another in an attack
SEQUENCES = [
    ("auth_fail", "auth"),
    ("auth", "execution"),
    ("auth", "privilege"),
    ("auth", "data_access"),
    ("email", "execution"),
    ("execution", "persistence"),
    ("execution", "privilege"),
    ("execution", "discovery"),
    ("execution", "credential_theft"),
    ("execution", "data_access"),
    ("privilege", "discovery"),
    ("privilege", "data_access"),
    ("privilege", "persistence"),
    ("persistence", "discovery"),
    ("credential_theft", "discovery"),
    ("credential_theft", "lateral"),
    ("discovery", "lateral"),
    ("discovery", "data_access"),
    ("lateral", "data_access"),
    ("lateral", "credential_theft"),
    ("data_access", "exfil"),
    ("lateral", "exfil"),
]

SEVERITY_ALIASES = {
    "info": "informational", "informational": "informational", "low": "low", "medium": "medium", "moderate": "medium",
    "high": "high", "critical": "critical", "crit": "critical", "severe": "critical",
}
SEVERITY_SCORES = {"informational": 10.0, "low": 30.0, "medium": 55.0, "high": 75.0, "critical": 92.0}

FAIL_TYPES = ["failed_login", "account_lockout", "mfa_fatigue", "password_spray_detected"]
SUCCESS_TYPES = ["login_success", "login_success_after_failures", "login_new_source", "new_device_login", "impossible_travel"]

#: keywords (all of them in the text) and alert type; the first rule that holds counts
KEYWORD_RULES = [
    (("password spray",), "password_spray_detected"),
    (("impossible travel",), "impossible_travel"),
    (("atypical travel",), "impossible_travel"),
    (("mfa",), "mfa_fatigue"),
    (("locked",), "account_lockout"),
    (("successful", "after", "fail"), "login_success_after_failures"),
    (("brute force",), "brute_force_detected"),
    (("failed", "sign"), "failed_login"),
    (("failed", "logon"), "failed_login"),
    (("unfamiliar sign-in",), "new_device_login"),
    (("new device",), "new_device_login"),
    (("anonymous ip",), "login_new_source"),
    (("unusual location",), "login_new_source"),
    (("new country",), "login_new_source"),
    (("lsass",), "credential_dump"),
    (("credential dump",), "credential_dump"),
    (("mimikatz",), "credential_dump"),
    (("encoded",), "encoded_command"),
    (("office", "child process"), "office_spawn_shell"),
    (("office", "spawn"), "office_spawn_shell"),
    (("powershell",), "powershell_execution"),
    (("certutil",), "suspicious_process"),
    (("script",), "script_execution"),
    (("phish",), "phishing_attachment_opened"),
    (("added to", "group"), "privilege_group_change"),
    (("privileged group",), "privilege_group_change"),
    (("role", "assign"), "privileged_role_assigned"),
    (("scheduled task",), "scheduled_task_created"),
    (("service", "install"), "new_service_installed"),
    (("new service",), "new_service_installed"),
    (("enumeration",), "account_discovery"),
    (("reconnaissance",), "account_discovery"),
    (("port scan",), "port_scan_internal"),
    (("remote desktop",), "remote_service_login"),
    (("rdp",), "remote_service_login"),
    (("lateral",), "remote_service_login"),
    (("exfiltration",), "large_data_transfer"),
    (("unusual volume", "upload"), "large_data_transfer"),
    (("mass download",), "bulk_data_access"),
    (("unusual volume",), "bulk_data_access"),
    (("sensitive", "access"), "sensitive_resource_access"),
    (("mail items accessed",), "mailbox_access"),
    (("mailbox",), "mailbox_access"),
    (("sign-in activity",), "login_success"),
]

#: part of a product's name and source, the first that holds
PRODUCT_SOURCES = [
    ("identity", "identity"),
    ("entra", "identity"),
    ("azure active directory", "identity"),
    ("endpoint", "endpoint"),
    ("defender for servers", "endpoint"),
    ("cloud apps", "cloud"),
    ("office 365", "email"),
    ("defender for office", "email"),
    ("firewall", "network"),
    ("network", "network"),
]

#: technique, name, tactics: public ATT&CK names
TECHNIQUES = [
    ("T1003", "OS Credential Dumping", ["credential-access"]),
    ("T1003.001", "OS Credential Dumping: LSASS Memory", ["credential-access"]),
    ("T1021", "Remote Services", ["lateral-movement"]),
    ("T1021.001", "Remote Services: Remote Desktop Protocol", ["lateral-movement"]),
    ("T1027", "Obfuscated Files or Information", ["defense-evasion"]),
    ("T1039", "Data from Network Shared Drive", ["collection"]),
    ("T1046", "Network Service Discovery", ["discovery"]),
    ("T1048", "Exfiltration Over Alternative Protocol", ["exfiltration"]),
    ("T1053.005", "Scheduled Task/Job: Scheduled Task", ["execution", "persistence", "privilege-escalation"]),
    ("T1059", "Command and Scripting Interpreter", ["execution"]),
    ("T1059.001", "Command and Scripting Interpreter: PowerShell", ["execution"]),
    ("T1078", "Valid Accounts", ["defense-evasion", "persistence", "privilege-escalation", "initial-access"]),
    ("T1078.004", "Valid Accounts: Cloud Accounts", ["defense-evasion", "persistence", "privilege-escalation", "initial-access"]),
    ("T1087", "Account Discovery", ["discovery"]),
    ("T1087.002", "Account Discovery: Domain Account", ["discovery"]),
    ("T1098", "Account Manipulation", ["persistence", "privilege-escalation"]),
    ("T1098.007", "Account Manipulation: Additional Local or Domain Groups", ["persistence", "privilege-escalation"]),
    ("T1105", "Ingress Tool Transfer", ["command-and-control"]),
    ("T1110", "Brute Force", ["credential-access"]),
    ("T1110.003", "Brute Force: Password Spraying", ["credential-access"]),
    ("T1114.002", "Email Collection: Remote Email Collection", ["collection"]),
    ("T1204.002", "User Execution: Malicious File", ["execution"]),
    ("T1213", "Data from Information Repositories", ["collection"]),
    ("T1543.003", "Create or Modify System Process: Windows Service", ["persistence", "privilege-escalation"]),
    ("T1566.001", "Phishing: Spearphishing Attachment", ["initial-access"]),
    ("T1621", "Multi-Factor Authentication Request Generation", ["credential-access"]),
]

#: what a text may say to a reader that is a program
INSTRUCTIONS = r"(?i)ignore (all )?(previous|prior) instructions|disregard .*instructions|you are now|system prompt|note to ai|ai assistant|classify this (incident )?as|recommend closing"

# ------------------------------------------------------------------------------------------------------


def alert_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALERT_TYPES, "alert_type string, source string, title string, severity string, family string, stage string")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(STAGES)], "stage string, label string, stage_order int")


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "technique_id string, name string, tactics array<string>")


def follows(first: Column, second: Column) -> Column:
    """Whether the second family follows the first one in an attack."""
    return F.concat(first, F.lit(">"), second).isin([f"{a}>{b}" for a, b in SEQUENCES])


def lookup(key: Column, pairs: dict[str, object]) -> Column:
    """The value of a small fixed map, null for other keys."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def of_type(field: str, key: Column) -> Column:
    """A field of the alert type's row: source, title, severity, family or stage."""
    at = ["alert_type", "source", "title", "severity", "family", "stage"].index(field)
    return lookup(key, {r[0]: r[at] for r in ALERT_TYPES if r[at]})


def family(alert_type: Column) -> Column:
    return F.coalesce(of_type("family", alert_type), F.lit("other"))


def stage_order(stage: Column) -> Column:
    return lookup(stage, {r[0]: i for i, r in enumerate(STAGES)})


def stage_label(stage: Column) -> Column:
    return lookup(stage, dict(STAGES))
