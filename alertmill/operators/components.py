"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators.hot import join_groups
from alertmill.sources.shared import written

#: Edges from which on the neighbours of one node are dealt to several tasks.
MANY = 200_000
#: Edges that a task holds at once; of each such stretch a spanning forest goes on.
STRETCH = 500_000
#: Centres up to which they are sent to all tasks.
SENT_ROWS = 1_000_000
#: Edges left by tasks from which on nodes are left out of the rounds unless they are the centre of a star.
CENTRES = 250_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", within: str | None = None, whole: int = 0) -> DataFrame:
    """node, component: the smallest node that each node of the edges reaches; with within, in each of its values apart.

    Each task first replaces its edges, a bounded stretch at a time, by stars around the smallest nodes that they
    join, which are fewer and shorter. Rounds of large and small stars then join what tasks found: every node passes its larger
    neighbours on to its smallest one, until each node has one smaller neighbour and that none. The
    number of rounds grows with the logarithm of the longest path, and the edges never grow in number. Edge
    rows alone are moved, minima are combined before the shuffle, a hub's neighbours are dealt to several tasks,
    and each round is a table in the shared folder. Of many edges, the rounds take only those between centres of tasks' stars; other nodes get their component from one of their centres. What tasks leave is joined in one more task if it is at most whole
    edges (STRETCH at most), else in rounds. Nulls and loops link nothing.
    """
    key = [within] if within else []
    now = edges.select(*key, F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = written(spanning_stars(now, key), "edges")
    if now.count() > max(whole, CENTRES):
        return _by_centres(now, key, whole)
    now = _rounds(now, key, whole)
    return now.select(*key, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(*key, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _by_centres(stars: DataFrame, key: list[str], whole: int) -> DataFrame:
    """key, node, component of the edges that spanning_stars() left: a node is joined to its smallest centre, and the centres that share a node to each other."""
    ends = stars.select(*key, F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast(stars.schema["v"].dataType).alias("to")))))
    nodes = ends.groupBy(*key, "node").agg(F.min("to").alias("centre"), F.max("to").alias("_last"), F.max(F.col("to").isNull()).alias("_is_centre"))
    nodes = written(nodes, "nodes")
    several = nodes.filter("centre < _last").select(*key, F.col("node").alias("u"), "centre")
    between = stars.join(several, [*key, "u"]).filter("v <> centre").select(*key, F.col("v").alias("u"), F.col("centre").alias("v"))
    between = between.unionByName(nodes.filter("_is_centre and centre is not null").select(*key, F.col("node").alias("u"), F.col("centre").alias("v"))).distinct()
    found = _rounds(written(spanning_stars(between, key), "edges"), key, whole).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("u").alias("_u"), F.col("v").alias("component"))
    found = written(found, "centres")
    placed = nodes.select(*key, "node", F.coalesce("centre", "node").alias("centre"))
    on = [(placed[k] == found[f"_{k}"]) for k in key] + [placed["centre"] == found["_u"]]
    if found.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        joined = placed.join(F.broadcast(found), on, "left")
    else:
        by_centre = placed.groupBy(*key, "centre").agg(F.count(F.lit(1)).alias("n"))
        on = [(by_centre[k] == found[f"_{k}"]) for k in key] + [by_centre["centre"] == found["_u"]]
        joined = join_groups(placed, written(by_centre.join(found, on, "left").select(*key, "centre", "n", "component"), "by-centre"), [*key, "centre"], ["node"])
    return joined.select(*key, "node", F.coalesce("component", "centre").alias("component"))


def _rounds(now: DataFrame, key: list[str], whole: int) -> DataFrame:
    """key, u, v: the edges as stars around the smallest node of each component (u > v)."""
    while True:
        near, size = _state(now, key)
        if near == 1:
            break
        if size <= min(whole, STRETCH):
            now = written(spanning_stars(now.coalesce(1), key), "edges")
            break
        many = size > MANY
        now = written(_small_star(_large_star(now, key, many), key, many), "edges")
    return now


def _state(edges: DataFrame, key: list[str]) -> tuple[int, int]:
    """1 if edges are the stars of their components (every node is one edge's larger end, or smaller ends alone), else 2; the number of edges."""
    ends = edges.select(*key, F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("above")), F.struct(F.col("v").alias("x"), F.lit(0).alias("above")))))
    seen = ends.groupBy(*key, "x").agg(F.sum("above").alias("above"), F.min("above").alias("below"))
    found = seen.agg(F.max(((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("below") == 0))).cast("int")), F.sum("above")).first()
    return 1 + (found[0] or 0), found[1] or 0


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest one that links a-b reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def spanning_stars(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, u, v: for each stretch of a task's edges, each node with the smallest one that they join it to (u > v)."""
    def stars(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ends = pa.concat_arrays([table.column(c).chunk(0) for c in ("u", "v")])
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(ends, names).to_numpy()
        n = len(names)
        if key:
            of = table.column(key[0]).chunk(0)
            items = pc.unique(of)
            item = np.tile(pc.index_in(of, items).to_numpy(), 2).astype(np.int64)
            codes, place = np.unique(item * n + place, return_inverse=True)
        else:
            codes = np.arange(n)
        half = table.num_rows
        root = roots(len(codes), place[:half], place[half:])
        own = np.flatnonzero(root != np.arange(len(codes)))
        columns = [names.take(pa.array(codes[own] % n)), names.take(pa.array(codes[root[own]] % n))]
        if key:
            columns.insert(0, items.take(pa.array(codes[own] // n)))
        return pa.RecordBatch.from_arrays(columns, names=[*key, "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= STRETCH:
                yield stars(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield stars(pa.Table.from_batches(held))

    schema = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*key, "u", "v"])
    return edges.mapInArrow(run, schema)


def _with_least(edges: DataFrame, least: DataFrame, key: list[str], many: bool) -> DataFrame:
    return join_groups(edges, least, [*key, "u"], ["v"]) if many else edges.join(least.drop("n"), [*key, "u"])


def _large_star(edges: DataFrame, key: list[str], many: bool) -> DataFrame:
    around = edges.unionByName(edges.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(around, least, key, many).filter("v > u").select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("u <> v").distinct()


def _small_star(edges: DataFrame, key: list[str], many: bool) -> DataFrame:
    """edges go from larger to smaller."""
    least = edges.groupBy(*key, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(edges, least, key, many)
    own = least.select(*key, "u", F.col("m").alias("v"))
    return joined.filter("v <> m").select(*key, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()
