"""Joins and percentiles that give no task a whole large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.sources.shared import written

#: Rows of a group up to which it is never dealt to several tasks.
SMALL_GROUP = 1000


def sent_if_small(table: DataFrame, rows: int) -> DataFrame:
    """A written table of narrow rows, to be sent to all tasks if it has at most that many rows; a larger one is joined by a shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows joined with the table of their groups (keys, n: the number of rows, and more); a group of many rows is dealt to several tasks.

    The P largest groups are found by n, P being the number of shuffle partitions, so what is sent to all tasks
    is bounded; those above the P-th one's size are cut into parts of that size, by a hash of the columns spread.
    Names are kept apart so that Spark sees one plan of groups in both places.
    """
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = Window.partitionBy()  # of P rows
    top = groups.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("n").alias("_n")).orderBy(F.desc("_n"), *[f"_hot_{k}" for k in keys]).limit(p)
    part = F.greatest(F.lit(SMALL_GROUP), F.when(F.count(F.lit(1)).over(whole) == p, F.min("_n").over(whole)).otherwise(0))
    hot = F.broadcast(top.withColumn("_salts", F.ceil(F.col("_n") / part).cast("int")).filter("_salts > 1").drop("_n"))
    same = lambda side: reduce(lambda x, y: x & y, [F.col(side + k) == F.col(f"_hot_{k}") for k in keys])
    placed = rows.join(hot, same(""), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.hash(*spread), "_salts"))).drop("_salts", *[f"_hot_{k}" for k in keys])
    named = groups.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in groups.columns if c not in (*keys, "n")])
    dealt = named.join(hot, same("_own_"), "left").withColumn("_own_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", *[f"_hot_{k}" for k in keys])
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_own_{k}") for k in keys] + [F.col("_salt") == F.col("_own_salt")])
    return placed.join(dealt, on).drop("_salt", "_own_salt", *[f"_own_{k}" for k in keys])


def exact_percentiles(rows: DataFrame, value: str, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """group, n and a column for each share: the exact percentile of the group's values that are not null, interpolated between two.

    Distinct values are counted, their counts sorted in sampled ranges, and each range is given what comes
    before it (a row for each range and group), so no task holds a group's values.
    """
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    counts = named.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    ranges = written(counts.repartitionByRange(p, "g", "v").withColumn("range", F.spark_partition_id()), "percentile-ranges")
    sizes = ranges.groupBy("g", "range").agg(F.sum("c").alias("s"))
    by_group = Window.partitionBy("g")
    sizes = sizes.select(F.col("g").alias("of_g"), F.col("range").alias("of_range"), (F.sum("s").over(by_group.orderBy("range")) - F.col("s")).alias("base"), F.sum("s").over(by_group).alias("n"))
    # as many rows as there are pairs of range and group
    placed = ranges.join(sizes, F.col("g").eqNullSafe(F.col("of_g")) & (F.col("range") == F.col("of_range")))
    upto = F.col("base") + F.sum("c").over(Window.partitionBy("g", "range").orderBy("v"))
    placed = placed.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("c"))
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("n") - 1)
        inside = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("upto")), F.col("v")))
        low, high = inside(F.floor(at)), inside(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    found = placed.groupBy("g").agg(F.max("n").alias("n"), *out)
    return found.withColumnRenamed("g", group) if group else found.drop("g")
