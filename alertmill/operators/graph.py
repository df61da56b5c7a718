"""The graph of an incident's entities: nodes, edges, pruning and degrees, for all incidents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_NODES, LEAST_RARITY, MAX_IDS = 200, 0.1, 50


def _refs(members: DataFrame, weights: DataFrame, ip_to_host: DataFrame | None) -> DataFrame:
    """members with the ids of up to six nodes each; common entities and an alert's own address are none.

    weights: entity_stats() of these alerts or of more. The common ones are few (below 0.1, an entity is in more than n^0.8 of n
    alerts) and sent to all tasks, so an entity that is in every alert, or null in most, brings no rows together.
    """
    common = weights.filter(F.col("weight") < LEAST_RARITY).select(F.col("entity_key").alias("_common"))
    out = members
    for c, kind in (("src_ip", "ip"), ("dst_ip", "ip"), ("user", "user"), ("host", "host"), ("process", "process"), ("resource", "resource")):
        key = F.concat(F.lit(f"{kind}:"), F.col(c)) if c != "dst_ip" else F.when(~F.col("dst_ip").eqNullSafe(F.col("src_ip")), F.concat(F.lit("ip:"), "dst_ip"))
        out = _rare(out.withColumn(f"n_{c}", key), f"n_{c}", common)
        if kind == "ip" and ip_to_host is not None:
            held = weights.filter(F.col("weight") >= LEAST_RARITY).select(F.col("entity_key").alias("_key"))
            at = ip_to_host.select(F.concat(F.lit("ip:"), "ip").alias(f"_at_{c}"), F.col("host").alias(f"at_{c}"), F.concat(F.lit("host:"), "host").alias("_key"))
            at = at.join(held.withColumn(f"okh_{c}", F.lit(True)), "_key", "left").drop("_key")  # on the side of the addresses, not of the alerts
            out = out.join(at, F.col(f"n_{c}") == F.col(f"_at_{c}"), "left")
            own = F.when(F.col(f"okh_{c}") & ~F.col(f"at_{c}").eqNullSafe(F.col("host")), F.concat(F.lit("host:"), f"at_{c}"))
            out = out.withColumn(f"n_{c}", F.when(F.col(f"at_{c}").isNotNull(), own).otherwise(F.col(f"n_{c}")))
    return out.select(*members.columns, *[f"n_{c}" for c in ("src_ip", "user", "host", "process", "resource", "dst_ip")])


def _rare(rows: DataFrame, column: str, common: DataFrame) -> DataFrame:
    """rows, with null for common entities."""
    found = rows.join(F.broadcast(common), F.col(column) == F.col("_common"), "left")
    return found.withColumn(column, F.when(F.col("_common").isNull(), F.col(column))).drop("_common")


def graph(members: DataFrame, weights: DataFrame, ip_to_host: DataFrame | None = None, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (incident_id, node, role, n_alerts, alert_ids, stages, degree, rarity) and edges (incident_id, source, target, relation, n_alerts, alert_ids).

    members: alerts with incident_id and stage (a label or null). The largest max_nodes nodes of an incident stay.
    """
    refs = _refs(members, weights, ip_to_host)
    src, user, host, proc, res, dst = (F.col(f"n_{c}") for c in ("src_ip", "user", "host", "process", "resource", "dst_ip"))
    roles = ((src, "source"), (user, "actor"), (host, "device"), (proc, "process"), (res, "target"), (dst, "destination"))
    each = F.array_compact(F.array(*[F.when(n.isNotNull(), F.struct(n.alias("node"), F.lit(r).alias("role"), F.lit(i).alias("at"))) for i, (n, r) in enumerate(roles)]))
    rows = refs.select("incident_id", "us", "pos", "alert_id", "stage", F.explode(each).alias("x")).select("incident_id", "us", "pos", "alert_id", "stage", "x.*").repartition("incident_id", "node")
    top = F.row_number().over(Window.partitionBy("incident_id", "node").orderBy("us", "pos", "at"))
    nodes = rows.withColumn("_place", top).groupBy("incident_id", "node").agg(
        F.min_by("role", "_place").alias("role"), F.count(F.lit(1)).alias("n_alerts"), F.min(F.struct("us", "pos", "at")).alias("seen"),
        F.array_sort(F.collect_list(F.when(F.col("_place") <= MAX_IDS, F.struct("us", "pos", "alert_id")))).getField("alert_id").alias("alert_ids"), F.array_sort(F.collect_set("stage")).alias("stages"),
    )
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("n_alerts"), "seen", "node"))
    nodes = nodes.withColumn("place", place).filter(F.col("place") <= max_nodes).drop("seen")
    link = lambda a, b, r: F.when(a.isNotNull() & b.isNotNull() & (a != b), F.struct(a.alias("source"), b.alias("target"), r.alias("relation")))
    links = F.array_compact(
        F.array(
            link(src, F.coalesce(user, host), F.when(user.isNotNull(), "authenticates as").otherwise("connects to")), link(user, host, F.lit("active on")), link(host, proc, F.lit("runs")),
            link(F.coalesce(proc, host, user), res, F.lit("accesses")), link(F.coalesce(res, host, user), dst, F.when(res.isNotNull(), "hosted on").otherwise("connects to")),
        )
    )
    pairs = refs.select("incident_id", "us", "pos", "alert_id", F.explode(links).alias("l")).select("incident_id", "us", "pos", "alert_id", "l.*")
    nth = F.row_number().over(Window.partitionBy("incident_id", "source", "target", "relation").orderBy("us", "pos"))
    edges = pairs.withColumn("_place", nth).groupBy("incident_id", "source", "target", "relation").agg(F.count(F.lit(1)).alias("n_alerts"), F.array_sort(F.collect_list(F.when(F.col("_place") <= MAX_IDS, F.struct("us", "pos", "alert_id")))).getField("alert_id").alias("alert_ids"))
    keep = nodes.select("incident_id", "node")
    edges = edges.join(keep.withColumnRenamed("node", "source"), ["incident_id", "source"], "left_semi").join(keep.withColumnRenamed("node", "target"), ["incident_id", "target"], "left_semi")
    ends = edges.select("incident_id", F.explode(F.array("source", "target")).alias("node")).groupBy("incident_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.join(weights.select(F.col("entity_key").alias("node"), F.col("weight").alias("rarity")), "node", "left")
    return nodes.join(ends, ["incident_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))), edges


def with_context(nodes: DataFrame, dimension: DataFrame) -> DataFrame:
    """nodes with level, what the contexts know of a user's privilege or a host's or resource's criticality. dimension: entities.entity_dimension()."""
    return nodes.join(dimension.select(F.concat_ws(":", "type", "value").alias("node"), "level"), "node", "left")
