"""How well incidents match ground truth: clustering, priorities, detection, medians, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.operators.hot import exact_percentiles


def _pairs(n):
    return n * (n - 1) / 2


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def clustering_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of pairwise and set metrics over alerts in both. pred: alert_id, incident_id; truth: alert_id, gt_id.

    Everything follows from the contingency table, so pairs are counted, never made.
    """
    cells = pred.join(truth, "alert_id").groupBy("incident_id", "gt_id").agg(F.count(F.lit(1)).alias("n"))
    by_pred = cells.groupBy("incident_id").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.count(F.lit(1)).alias("kinds"))
    by_true = cells.groupBy("gt_id").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
    a = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"), F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("same"))
    b = by_pred.agg(
        F.count(F.lit(1)).alias("incidents"), F.coalesce(F.sum(_pairs(F.col("size"))), F.lit(0.0)).alias("pred_pairs"), F.coalesce(F.sum("top"), F.lit(0)).alias("pure"), F.count_if(F.col("size") > 1).alias("multi"),
        F.count_if((F.col("size") > 1) & (F.col("kinds") > 1)).alias("merged"), F.count_if(F.col("size") == 1).alias("single"),
    )
    c = by_true.agg(F.count(F.lit(1)).alias("truths"), F.coalesce(F.sum(_pairs(F.col("size"))), F.lit(0.0)).alias("true_pairs"), F.count_if(F.col("size") > 1).alias("true_multi"), F.count_if((F.col("size") > 1) & (F.col("kinds") > 1)).alias("split"))
    all_ = a.crossJoin(b).crossJoin(c).withColumns({"p": _ratio(F.col("same"), F.col("pred_pairs")), "r": _ratio(F.col("same"), F.col("true_pairs"))})
    return all_.select(
        "alerts", "incidents", "truths", F.round("p", 4).alias("pairwise_precision"), F.round("r", 4).alias("pairwise_recall"), F.round(_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 4).alias("pairwise_f1"),
        F.round(_ratio(F.col("pure"), F.col("alerts")), 4).alias("purity"), F.round(_ratio(F.col("merged"), F.col("multi")), 4).alias("over_merge_rate"), F.round(_ratio(F.col("split"), F.col("true_multi")), 4).alias("split_rate"),
        F.round(_ratio(F.col("single"), F.col("incidents")), 4).alias("singleton_rate"), F.round(_ratio(F.col("alerts"), F.col("incidents")), 2).alias("compression"),
    )


def dominant_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """dominant_of() alerts in both. pred: alert_id, incident_id; truth: alert_id, gt_id."""
    return dominant_of(pred.join(truth, "alert_id"))


def dominant_of(rows: DataFrame) -> DataFrame:
    """incident_id, gt_id (the most frequent one; ties: the smallest id), share. rows: alerts with incident_id and gt_id."""
    cells = rows.groupBy("incident_id", "gt_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("n"), "gt_id"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("incident_id"))
    return cells.withColumns({"place": place, "share": share}).filter("place = 1").select("incident_id", "gt_id", "share")


def best_ranks(ranked: DataFrame, dominant: DataFrame) -> DataFrame:
    """gt_id and the best rank of an incident that it dominates."""
    return ranked.join(dominant, "incident_id").groupBy("gt_id").agg(F.min("rank").alias("rank"))


def planted_ranks(ranked: DataFrame, dominant: DataFrame, truths: DataFrame) -> DataFrame:
    """gt_id, priority and the best rank (null: none) of each malicious truth."""
    return truths.filter("malicious").select("gt_id", "priority").join(best_ranks(ranked, dominant), "gt_id", "left")


def priority_metrics(ranked: DataFrame, dominant: DataFrame, truths: DataFrame) -> DataFrame:
    """One row. ranked: incident_id, rank, severity; truths: gt_id, priority, malicious."""
    found = truths.join(best_ranks(ranked, dominant), "gt_id", "left")
    urgent = F.col("priority").isin("high", "critical")
    a = found.agg(F.count_if(F.col("priority") == "critical").alias("critical"), F.count_if((F.col("priority") == "critical") & (F.col("rank") <= 3)).alias("top3"), F.count_if(urgent).alias("urgent"), F.count_if(urgent & (F.col("rank") <= 5)).alias("top5"))
    benign = ranked.join(dominant, "incident_id").join(truths, "gt_id", "left").filter(~F.coalesce("malicious", F.lit(False)))
    b = benign.agg(F.count(F.lit(1)).alias("benign_incidents"), F.count_if(F.col("severity").isin("high", "critical")).alias("false_high_count"))
    return a.crossJoin(b).select(
        F.when(F.col("critical") > 0, F.round(F.col("top3") / F.col("critical"), 4)).alias("top3_critical_recall"), F.when(F.col("urgent") > 0, F.round(F.col("top5") / F.least(F.lit(5), F.col("urgent")), 4)).alias("top5_urgent_recall"),
        F.round(_ratio(F.col("false_high_count"), F.col("benign_incidents")), 4).alias("false_high_rate"), "false_high_count", "benign_incidents",
    )


def detection_metrics(scored: DataFrame, score: str, malicious: str, threshold: float = 0.5) -> DataFrame:
    """One row: the confusion matrix of score >= threshold against a boolean, and its rates."""
    flagged, bad = F.col(score) >= threshold, F.coalesce(F.col(malicious), F.lit(False))
    m = scored.agg(F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))
    m = m.withColumns({"p": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return m.select("tp", "fp", "fn", "tn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 4).alias("f1"), F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("false_positive_rate"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n (rows) and the exact median of the values that are not null."""
    found = exact_percentiles(rows, value, {"median": 0.5}, group).drop("n").withColumnRenamed(group, "_g")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", "median")


def claim_rates(ratings: DataFrame) -> DataFrame:
    """provider, n, rate: the mean of the facts' ratings that are 0 or 1."""
    good = ratings.filter((F.col("kind") == "fact") & F.col("rating").isin("0", "1"))
    return good.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("rating").cast("int")), 4).alias("rate"))


def brief_metrics(reports: DataFrame) -> DataFrame:
    """One row over citation reports: briefs, fallbacks, and the shares with valid schema and citations."""
    s = reports.agg(F.count(F.lit(1)).alias("briefs"), F.count_if("fallback").alias("fallbacks"), F.count_if("schema_valid").alias("valid"), F.sum("citations_checked").alias("cited"), F.sum("invalid_citations").alias("bad"))
    return s.select("briefs", "fallbacks", F.round(_ratio(F.col("valid"), F.col("briefs")), 4).alias("schema_valid_rate"), F.round(_ratio(F.col("cited") - F.col("bad"), F.col("cited")), 4).alias("citation_valid_rate"))


def triage_summary(trials: DataFrame) -> DataFrame:
    """mode, n, median_seconds, accuracy, and the reduction of the median against mode manual, in percent."""
    right = trials.groupBy("mode").agg(F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))
    by = medians(trials, "mode", "seconds").withColumnRenamed("median", "median_seconds").join(right, "mode")
    manual = by.filter("mode = 'manual'").select(F.col("median_seconds").alias("_base"))
    base = manual.agg(F.max("_base").alias("_base"))
    return by.crossJoin(F.broadcast(base)).withColumn("reduction_percent", F.round(100 * (1 - F.col("median_seconds") / F.col("_base")), 1)).drop("_base")
