"""Similarity of titles (n-grams), of sets and of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.sources.shared import written


def title_grams(titles: DataFrame, column: str = "title") -> DataFrame:
    """title, gram, w: the L2-normed TF-IDF weights of the distinct titles' character 3- to 5-grams inside padded words."""
    distinct = titles.select(F.lower(F.col(column)).alias("low"), F.col(column).alias("title")).filter("title is not null").distinct()
    words = distinct.select("title", F.explode(F.split("low", r"\s+")).alias("w")).filter("w <> ''").withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    sizes = words.select("title", "w", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("n"))
    grams = sizes.filter("length(w) >= n").select("title", F.explode(F.expr("transform(sequence(1, length(w) - n + 1), i -> substring(w, i, n))")).alias("gram"))
    tf = grams.groupBy("title", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "gram").crossJoin(F.broadcast(distinct.agg(F.count_distinct("title").alias("n"))))
    weighted = weighted.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy("title").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "title").select("title", "gram", (F.col("w") / F.col("norm")).alias("w"))


def title_similarity(titles: DataFrame, column: str = "title", pairs: DataFrame | None = None) -> DataFrame:
    """a, b, similarity: the cosine of each two distinct titles that share a gram, a < b. Equal titles have 1 and no row.

    With pairs (a, b): of those alone, however many titles share a common gram. Without, the join is on grams,
    so titles without one in common meet nowhere; meant for few titles.
    """
    g = title_grams(titles, column)
    first, other = g.withColumnRenamed("title", "a"), g.select(F.col("title").alias("b"), "gram", F.col("w").alias("wb"))
    met = first.join(other, "gram").filter("a < b") if pairs is None else pairs.select("a", "b").join(first, "a").join(other, ["b", "gram"])
    return met.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("wb")).alias("similarity"))


def similar_titles(titles: DataFrame, least: float, column: str = "title") -> DataFrame:
    """a, b, similarity of all pairs of distinct titles whose cosine is at least least (above 0), a < b.

    A title's grams are ordered from the rarest in all titles to the commonest, and its prefix ends where the rest has a norm
    below least. Two titles that are similar share their rarest common gram in both prefixes, and at it the norms of what is
    left of both bound the cosine; only pairs that pass are compared in full. Common grams, which most
    titles share, are in few prefixes.
    """
    if least <= 0:
        raise ValueError("least must be above 0; title_similarity() gives all pairs")
    g = written(title_grams(titles, column), "title-grams")
    ranked = g.join(g.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    rest = Window.partitionBy("title").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = ranked.withColumn("left", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).filter(F.col("left") >= least - 1e-9)
    first, other = prefix.select("gram", F.col("title").alias("a"), F.col("left").alias("la")), prefix.select("gram", F.col("title").alias("b"), F.col("left").alias("lb"))
    pairs = first.join(other, "gram").filter((F.col("a") < F.col("b")) & (F.col("la") * F.col("lb") >= least - 1e-9)).select("a", "b").distinct()
    whole = pairs.join(g.withColumnRenamed("title", "a"), "a").join(g.select(F.col("title").alias("b"), "gram", F.col("w").alias("wb")), ["b", "gram"])
    return whole.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


def similar_sets(sets: DataFrame, key: str, token: str, least: float = 0.2, top: int = 3) -> DataFrame:
    """key, other, similarity, place: the top partners by Jaccard above least. sets: a row for each key and token.

    Tokens are joined, not keys: pairs without a common token never meet. Meant for a bounded choice of keys
    (the riskiest incidents), whose tokens may all be common.
    """
    one = sets.select(F.col(key).alias("key"), F.col(token).alias("token")).distinct()
    sizes = one.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    left = one.join(sizes, "key")
    right = left.select(F.col("key").alias("other"), "token", F.col("n").alias("m"))
    common = left.join(right, "token").filter("key <> other").groupBy("key", "other", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    near = common.withColumn("similarity", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).filter(F.col("similarity") > least)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    return near.withColumn("place", place).filter(F.col("place") <= top).select(F.col("key").alias(key), "other", F.round("similarity", 4).alias("similarity"), "place")


def cosine(a, b):
    """The cosine of two array columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_to_centroid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and the cosine of each vector to the mean of its label's vectors."""
    at = vectors.select(label_col, F.posexplode(vector_col).alias("i", "x"))
    mean = at.groupBy(label_col, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = mean.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).getField("x").alias("c"))
    return vectors.join(centroids, label_col).select(id_col, label_col, cosine(F.col(vector_col), F.col("c")).alias("similarity"))
