"""Raw alerts to canonical ones: column expressions for identities, addresses, times, severities and hashes."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.functions import catalog

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: networks that count as internal
INTERNAL = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"]
_INTERNAL_6 = ["fc00::/7", "::1/128"]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def canonical_user(c: Column) -> Column:
    """What stands after the first backslash and before the first @, lower-cased."""
    return blank_to_null(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[^\\]*\\", ""), "@.*$", "")))


def canonical_host(c: Column) -> Column:
    """Upper-cased without the local domain endings, each cut once, in order."""
    cut = reduce(lambda x, end: F.regexp_replace(x, rf"\.{end}$", ""), [r"corp\.local", r"corp\.example", "local"], F.lower(F.trim(c)))
    return blank_to_null(F.upper(cut))


def canonical_name(c: Column) -> Column:
    return blank_to_null(F.lower(F.trim(c)))


def parse_time(c: Column) -> Column:
    """ISO 8601 (without an offset: UTC) or seconds, or milliseconds above 1e11, since 1970; else null."""
    text = F.trim(c)
    number = text.try_cast("double")
    epoch = F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_micros((number * 1e6).cast("long")))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), epoch).when(text.rlike(_ISO), text.try_cast("timestamp"))


def ipv4_number(c: Column) -> Column:
    """A valid IPv4 address as a number, else null."""
    part = F.split(c, r"\.")
    return F.when(c.rlike(IPV4), reduce(lambda x, i: x * 256 + part[i].cast("long"), range(4), F.lit(0).cast("long")))


def _prefixes(net: str) -> str:
    """A pattern of how addresses of a network begin, by whole octets; the last of them may be a range."""
    found = ipaddress.ip_network(net)
    whole, rest = divmod(found.prefixlen, 8)
    octets = str(found.network_address).split(".")
    own = octets[:whole]
    if rest:
        own.append("(" + "|".join(str(int(octets[whole]) + i) for i in range(1 << (8 - rest))) + ")")
    return r"\.".join(own)


_INTERNAL_4 = "^(" + "|".join(_prefixes(x) for x in INTERNAL) + r")\."


def is_internal_v4(c: Column) -> Column:
    """Whether a valid IPv4 address lies in an internal network; null for other texts."""
    return F.when(c.rlike(IPV4), c.rlike(_INTERNAL_4))


@F.pandas_udf(T.StructType([T.StructField("ip", T.StringType()), T.StructField("internal", T.BooleanType())]))
def _ipv6(values: pd.Series) -> pd.DataFrame:
    nets = [ipaddress.ip_network(x) for x in _INTERNAL_6]

    def one(v):
        try:
            found = ipaddress.ip_address(v)
        except ValueError:
            return None, None
        return str(found), any(found in x for x in nets if found.version == x.version)

    return pd.DataFrame([one(v) if v is not None else (None, None) for v in values], columns=["ip", "internal"])


def with_ip(df: DataFrame, column: str, ipv6: bool = True) -> DataFrame:
    """Adds <column>_ok, <column>_private and the canonical text in column itself. Only IPv6 rows see Python."""
    c = F.trim(F.col(column))
    out = df.withColumn(column, F.when(c != "", c))
    if ipv6:
        out = out.withColumn("_v6", _ipv6(F.when(F.col(column).contains(":"), F.col(column))))
        return out.withColumns(
            {
                f"{column}_ok": F.col(column).isNull() | F.col(column).rlike(IPV4) | F.col("_v6.ip").isNotNull(),
                f"{column}_private": F.coalesce(is_internal_v4(F.col(column)), F.col("_v6.internal")),
                column: F.coalesce(F.col("_v6.ip"), F.col(column)),
            }
        ).drop("_v6")
    return out.withColumns({f"{column}_ok": F.col(column).isNull() | F.col(column).rlike(IPV4), f"{column}_private": is_internal_v4(F.col(column))})


def severity_label(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("informational")


def severity(label: Column, score: Column) -> tuple[Column, Column, Column]:
    """Label, score and an error (or null): an unknown label, a score outside 0..100, or neither given."""
    text = blank_to_null(F.lower(F.trim(label)))
    known = catalog.lookup(text, catalog.SEVERITY_ALIASES)
    number = score.try_cast("double")
    error = (
        F.when(score.isNotNull() & number.isNull(), "severity_score is not a number")
        .when((number < 0) | (number > 100) | F.isnan(number), "severity_score outside 0..100")
        .when(text.isNotNull() & known.isNull(), "unknown severity")
        .when(text.isNull() & number.isNull(), "missing severity")
    )
    full = F.coalesce(number, catalog.lookup(known, catalog.SEVERITY_SCORES))
    return F.coalesce(known, severity_label(full)), full, error


#: fields of the content hash, in name order; ids, severity and confidence do not count
HASHED = ["alert_type", "attributes", "dst_ip", "host", "process", "resource", "source", "src_ip", "timestamp", "title", "user", "vendor"]


def content_hash(fields: dict[str, Column]) -> Column:
    """24 hexadecimal digits; two alerts have equal ones if their canonical fields are equal. Null and text never coincide."""
    parts = [F.coalesce(F.concat(F.lit("="), fields[k].cast("string")), F.lit("-")) for k in HASHED]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def sorted_json(c: Column) -> Column:
    """JSON text with sorted keys, so that equal objects are equal texts; null if it is none."""
    return F.to_json(F.try_parse_json(c))


def normalize(raw: DataFrame, users: DataFrame | None = None, hosts: DataFrame | None = None, resources: DataFrame | None = None, ipv6: bool = True) -> DataFrame:
    """Canonical columns beside `errors` (all failing checks of a row; empty: accepted) and `pos`.

    raw has the text columns of an alert (missing ones count as null), timestamp, severity, severity_score and
    confidence among them, a row number pos, and attributes as JSON text. Contexts: users (user, privilege),
    hosts (host, criticality), resources (resource, criticality); small, but joined, so of any size.
    """
    names = [
        "alert_id", "timestamp", "source", "vendor", "alert_type", "title", "severity", "severity_score", "confidence", "user", "host", "src_ip", "dst_ip",
        "process", "resource", "asset_criticality", "user_privilege", "attributes",
    ]
    have = set(raw.columns)
    given = raw.select("pos", *[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in names], (F.col("has_confidence") if "has_confidence" in have else F.lit("confidence" in have)).alias("has_confidence"))
    step = given.withColumns(
        {
            "alert_id": blank_to_null(F.trim("alert_id")), "alert_type": blank_to_null(F.trim("alert_type")), "ts": parse_time(F.col("timestamp")),
            "user": canonical_user(F.col("user")), "host": canonical_host(F.col("host")), "process": canonical_name(F.col("process")), "resource": canonical_name(F.col("resource")),
        }
    )
    step = with_ip(with_ip(step, "src_ip", ipv6), "dst_ip", ipv6)
    label, score, bad_severity = severity(F.col("severity"), F.col("severity_score"))
    confidence = F.col("confidence").try_cast("double")
    object_ = F.col("attributes").isNull() | (F.get_json_object("attributes", "$").startswith("{") & F.try_parse_json("attributes").isNotNull())
    early = F.array_compact(
        F.array(
            F.when(F.col("alert_id").isNull(), "missing alert_id"), F.when(F.col("alert_type").isNull(), "missing alert_type"), F.when(F.col("ts").isNull(), "bad timestamp"),
            bad_severity, F.when(~F.col("src_ip_ok"), "bad src_ip"), F.when(~F.col("dst_ip_ok"), "bad dst_ip"), F.when(~F.coalesce(object_, F.lit(False)), "attributes is not an object"),
        )
    )
    late = F.col("has_confidence") & (confidence.isNull() | ~confidence.between(0, 1))
    step = step.withColumns({"severity": label, "severity_score": score, "_early": early, "_late": F.coalesce(late, F.lit(True)), "attributes": F.coalesce(sorted_json(F.col("attributes")), F.lit("{}"))})
    step = step.withColumn("errors", F.when(F.size("_early") > 0, F.col("_early")).when(F.col("_late"), F.array(F.lit("confidence outside 0..1"))).otherwise(F.array().cast("array<string>")))
    step = step.withColumn("content_hash", content_hash({k: F.unix_micros("ts") if k == "timestamp" else F.col(k) for k in HASHED}))
    step = enrich(step, users, hosts, resources)
    kind = F.col("alert_type")
    return step.select(
        "pos", "alert_id", "ts", F.unix_micros("ts").alias("us"),
        F.coalesce("source", catalog.of_type("source", kind), F.lit("unknown")).alias("source"), F.coalesce("vendor", F.lit("unknown")).alias("vendor"), "alert_type",
        F.coalesce("title", catalog.of_type("title", kind), kind).alias("title"), "severity", "severity_score", F.when(F.col("has_confidence"), confidence).otherwise(0.7).alias("confidence"),
        "user", "host", "src_ip", "src_ip_private", "dst_ip", "dst_ip_private", "process", "resource", "asset_criticality", "user_privilege", "attributes", "content_hash", "errors",
    )


def enrich(df: DataFrame, users: DataFrame | None, hosts: DataFrame | None, resources: DataFrame | None) -> DataFrame:
    """asset_criticality and user_privilege: as given, else from the contexts (the larger of host and resource), else 1; within 1..5."""
    out = df
    for dim, key, value in ((users, "user", "privilege"), (hosts, "host", "criticality"), (resources, "resource", "criticality")):
        name = f"_{key}_{value}"
        if dim is None:
            out = out.withColumn(name, F.lit(None).cast("int"))
        else:
            out = out.join(dim.select(F.col(key), F.col(value).cast("int").alias(name)).dropDuplicates([key]), key, "left")
    bound = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), c.try_cast("double").cast("int")))
    return out.withColumns(
        {
            "asset_criticality": bound(F.coalesce(F.col("asset_criticality"), F.greatest("_host_criticality", "_resource_criticality").cast("string"), F.lit("1"))),
            "user_privilege": bound(F.coalesce(F.col("user_privilege"), F.col("_user_privilege").cast("string"), F.lit("1"))),
        }
    ).drop("_user_privilege", "_host_criticality", "_resource_criticality")


def has_instructions(title: Column, values: Column) -> Column:
    """Whether a title or any attribute value (its first 200 characters) speaks to a program that reads it."""
    return F.concat_ws(" ", title, F.transform(values, lambda x: F.substring(x, 1, 200))).rlike(catalog.INSTRUCTIONS)


def valid_techniques(c: Column) -> Column:
    """Technique ids of an array, a JSON array or a comma-separated text."""
    parts = F.split(F.regexp_replace(c, r'[\[\]"]', ""), ",")
    return F.filter(F.transform(parts, F.trim), lambda x: x.rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"))


def risk_label(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def classify(name: Column, kind: Column, description: Column) -> Column:
    """Alert type of a vendor's alert: a native type stands for itself, else the first keyword rule that holds, else the generic type."""
    text = F.lower(F.concat_ws(" ", name, kind, description))
    native = F.when(kind.isin([r[0] for r in catalog.ALERT_TYPES]), kind)
    rules = [F.when(reduce(lambda x, y: x & y, [text.contains(k) for k in keys]), F.lit(to)) for keys, to in catalog.KEYWORD_RULES]
    return F.coalesce(native, *rules, F.lit("sentinel_alert"))


def product_source(product: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(product).contains(part), F.lit(to)) for part, to in catalog.PRODUCT_SOURCES], F.lit("sentinel"))
