"""An isolation forest whose trees are grown in parallel tasks and applied as one small broadcast table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 200, 256, 7
#: Rows that a task scores at once.
BLOCK_ROWS = 200_000
#: behavioural features; the four counts enter as log1p
COLUMNS = ["fails_user_10m", "fails_ip_10m", "users_per_ip_60m", "hosts_per_user_60m", "novel_source", "off_hours", "process_rarity", "novel_process", "success_after_failures"]


def path_bonus(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature or -1, split, left, right, path length at a leaf), the root first."""
    nodes, todo = [None], [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and depth < limit else []
        if not len(spread):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(path_bonus(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(nodes[at][2], left, depth + 1), (nodes[at][3], right, depth + 1)]
    return nodes


def draws(rows: DataFrame, share: float, trees: int, seed: int, id_col: str = "id") -> DataFrame:
    """rows with tree: each row in each tree with the probability share, whatever other rows and trees do.

    From a hash of the row follow the gaps between the trees that take it, which are geometric; a row whose first gap is
    beyond the last tree is dropped by a filter. Work grows with rows and with what is drawn, not with their product with trees.
    """
    if share >= 1:
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    base = float(np.log1p(-share))
    first = F.floor(F.log1p(-(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53))) / base)
    near = rows.withColumn("h", F.xxhash64(id_col, F.lit(seed))).withColumn("tree", first).filter(F.col("tree") < trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, tree = batch.column("h").to_numpy().view(np.uint64), batch.column("tree").to_numpy().copy()
            at, out = np.arange(len(h)), []
            for j in range(1, trees + 1):
                if not len(at):
                    break
                out.append((at, tree[at]))
                x = h[at] + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))  # splitmix64: the row's j-th number
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
                gap = np.minimum(np.floor(np.log1p(-u) / base), trees)
                tree[at] += 1 + gap.astype(np.int64)
                at = at[tree[at] < trees]
            taken = np.concatenate([np.empty(0, np.int64), *[x for x, _ in out]])
            found = batch.take(pa.array(taken)).drop_columns(["h", "tree"])
            yield found.append_column("tree", pa.array(np.concatenate([np.empty(0, np.int64), *[x for _, x in out]]).astype(np.int32)))

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return near.mapInArrow(run, f"{kinds}, tree int")


def fit(rows: DataFrame, columns: list[str] = COLUMNS, id_col: str = "pos", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """tree, node, feature, cut, left, right, path: sample rows for each tree, the smallest by a hash of id and tree.

    draws() lets about three samples through for each tree, so a tree's task gets a few hundred rows at any size. The
    sample is bounded by trees x sample rows; scores cover all rows.
    """
    logs = [F.log1p(F.col(c).cast("double")).alias(c) if i < 4 else F.col(c).cast("double").alias(c) for i, c in enumerate(columns)]
    n = rows.count()
    small = rows.select(F.col(id_col).alias("id"), *logs)
    drawn = draws(small, 3 * sample / n if n > 4 * sample else 1.0, trees, seed).withColumn("h", F.xxhash64("id", "tree", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))
    chosen = drawn.withColumn("place", place).filter(F.col("place") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("place")[columns].to_numpy(float)
        nodes = _grow(x, np.random.default_rng(seed * 1000 + tree), int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame([(tree, i, *v) for i, v in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    return chosen.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, path double")


def score(rows: DataFrame, forest: DataFrame, columns: list[str] = COLUMNS, id_col: str = "pos", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep and forest_raw (near 1: easily isolated) of each row. The forest has at most trees x 2 x sample nodes, so it is sent to all tasks.

    Rows are taken BLOCK_ROWS at a time, and equal ones go down the trees once.
    """
    table = forest.orderBy("tree", "node").toPandas()
    by_tree = [g[["feature", "cut", "left", "right", "path"]].to_numpy(float) for _, g in table.groupby("tree")]
    shared = rows.sparkSession.sparkContext.broadcast(by_tree)
    unit = float(path_bonus(min(sample, max(2, rows.count()))))
    out = [id_col, *keep]

    def scored(rows: pa.Table) -> pa.RecordBatch:
        x = np.empty((rows.num_rows, len(columns)))
        for i, c in enumerate(columns):
            x[:, i] = rows.column(f"_{c}").to_numpy()
        _, first, which = np.unique(x.view(f"V{8 * len(columns)}").ravel(), return_index=True, return_inverse=True)
        raw = pa.array(2.0 ** (-paths(x[first])[which] / max(1, len(shared.value)) / unit))
        return rows.select(out).append_column("forest_raw", raw).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield scored(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield scored(pa.Table.from_batches(held))

    def paths(x: np.ndarray) -> np.ndarray:
        x[:, :4] = np.log1p(x[:, :4])
        total = np.zeros(len(x))
        for nodes in shared.value:
            at = np.zeros(len(x), int)
            while True:
                f = nodes[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                left = x[inner, f[inner]] <= nodes[at[inner], 1]
                at[inner] = np.where(left, nodes[at[inner], 2], nodes[at[inner], 3]).astype(int)
            total += nodes[at, 4]
        return total

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out)
    return rows.select(*out, *[F.col(c).cast("double").alias(f"_{c}") for c in columns]).mapInArrow(run, f"{kinds}, forest_raw double")
