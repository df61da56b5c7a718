"""Near-duplicate vectors (12): cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact checks.

A vector is turned by sign flips and Hadamard transforms; the axis nearest to it, with its sign, is one hash, and
AXES of them name a bucket of a table. Each vector enters its PROBES likeliest buckets of each of TABLES tables. Pairs
of a bucket are compared in full inside tasks, by blocks of two chunks, and a pair counts in the smallest bucket
that its two vectors share, so links are counted once though no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import partitions, written
from alertmill.llm.textops import mix, ranges
from alertmill.operators.components import connected_components
from alertmill.operators.hot import join_groups

#: At cosine 0.93 in 64 dimensions two vectors miss each other with probability 0.0002; at 0.95 with some 1e-5.
TABLES, AXES, PROBES = 8, 3, 4
#: Axes of one rotation that probing looks at.
LOOKED = 4
LEAST_COSINE = 0.93
#: Vectors of a chunk: two chunks, their buckets and cosines are what a task holds of a bucket.
CHUNK = 1024
#: Pairs of small buckets that are compared at once.
PAIRS_AT_ONCE = 50_000
SEED = 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their scale."""
    x = vectors.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(x: np.ndarray, tables: int = TABLES, axes: int = AXES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For each row of unit vectors the 64-bit names of its buckets: rows x (tables * probes), a table's likeliest ones first."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    looked = min(LOOKED, width)
    rng = np.random.default_rng([seed, width])
    out = []
    for t in range(tables):
        names, costs = np.full((n, 1), t, np.uint64), np.zeros((n, 1))
        for _ in range(axes):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            near = np.argpartition(-np.abs(y), looked - 1, axis=1)[:, :looked]
            value = np.take_along_axis(y, near, 1)
            size = np.abs(value)
            cost = (size.max(axis=1, keepdims=True) - size) ** 2
            hashes = (near * 2 + (value < 0)).astype(np.uint64)
            names = (names[:, :, None] * np.uint64(2 * width) + hashes[:, None, :]).reshape(n, -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
        best = np.lexsort((names, costs), axis=1)[:, :probes]
        out.append(mix(np.take_along_axis(names, best, 1)))
    return np.concatenate(out, axis=1).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def representatives(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as vec_id, label, h and g (two hashes of the vector; null where it can link with nothing), and the written table of different vectors: label, h, g, node, n, least (vec_id), dim, v."""
    v = vectors[vector_col].cast("array<double>")
    fit = F.coalesce(vectors[label_col].isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), F.when(fit, v).alias("v"))
    rows = rows.select("vec_id", "label", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v")).alias(c) for i, c in ((1, "h"), (2, "g"))])
    alike = rows.filter("v is not null").groupBy("label", "h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    alike = alike.select("label", "h", "g", F.monotonically_increasing_id().alias("node"), "n", "least", F.size("v").alias("dim"), "v")
    return rows.drop("v"), written(alike, "vector-groups")


def coded(reps: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """label, dim, node, n, v (of length 1) and codes of representatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = units(_matrix(part.column("v")))
                codes = bucket_codes(x, tables, axes, probes)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(k)) for y, k in ((x, pa.float64()), (codes, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "dim", "node", "n")), *lists], ["label", "dim", "node", "n", "v", "codes"])

    kind = reps.schema["label"].dataType.simpleString()
    return reps.select("label", "dim", "node", "n", "v").mapInArrow(run, f"label {kind}, dim int, node long, n long, v array<double>, codes array<long>")


def in_blocks(codes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """label, dim, bucket, block, side and the columns of coded(), a row for each block of a vector's buckets that hold others.

    A bucket is cut into chunks of some chunk vectors by a hash; block i * chunks + j, i <= j, holds two of
    them, so a bucket of any size is many tasks' work and rows hold at most its chunks each, not its pairs. Buckets with one
    vector are left out before vectors are moved.
    """
    entries = codes.select("label", "dim", "node", F.explode("codes").alias("bucket"))
    buckets = entries.groupBy("label", "dim", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = buckets.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    shared = join_groups(entries, buckets, ["label", "dim", "bucket"], ["node"])
    own = F.pmod(F.xxhash64("node", F.lit(31)), F.col("chunks")).cast("int")
    shared = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    shared = shared.select(F.col("node").alias("of_node"), "bucket", (low * F.col("chunks") + high).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"), (low == high).alias("inside"))
    return shared.join(codes, F.col("of_node") == F.col("node")).drop("of_node")


def _first_shared(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """The smallest bucket that each row of a shares with the same row of b. Buckets of different tables never agree, so tables are met in turn."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(0, a.shape[1], probes):
        for p in range(probes):
            met = (b[:, t : t + probes] == a[:, t + p, None]).any(axis=1)
            least = np.where(met, np.minimum(least, a[:, t + p]), least)
    return least


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest one that links a-b reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def linked(blocks: DataFrame, least: float, probes: int) -> DataFrame:
    """node, links (of its other vectors, those counted in one stretch of blocks) and root, the smallest node that they join it with there.

    blocks come sorted; whole blocks are worked on as their rows are complete, small ones together.
    """
    def found(x: np.ndarray, codes: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(np.einsum("ij,ij->i", x[i], x[j]) >= least)
        i, j = i[near], j[near]
        first = _first_shared(codes[i], codes[j], probes) == bucket[i]
        return i[first], j[first]

    def links(x, codes, bucket, side, inside, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        ii, jj = [], []
        small = ends - starts <= 64
        s, size = starts[small], (ends - starts)[small]
        at = np.repeat(s, size) + ranges(size)  # rows of small blocks, each with those after it
        after = np.repeat(s + size, size) - at - 1
        cut = np.searchsorted(np.cumsum(after), np.arange(PAIRS_AT_ONCE, after.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        for rows, n in zip(np.split(at, np.unique(cut)), np.split(after, np.unique(cut)), strict=True):
            i = np.repeat(rows, n)
            j = i + 1 + ranges(n)
            use = inside[i] | (side[i] != side[j])
            for to, y in zip((ii, jj), found(x, codes, bucket, i[use], j[use]), strict=True):
                to.append(y)
        for lo, hi in zip(starts[~small], ends[~small], strict=True):
            y = x[lo:hi]
            for k in range(lo, hi, 256):  # cosines of 256 rows with all: then the near pairs alone
                i, j = np.nonzero(x[k : min(k + 256, hi)] @ y.T >= least - 1e-9)
                i, j = i + k, j + lo
                use = (i < j) & (inside[i] | (side[i] != side[j]))
                for m in range(0, use.sum(), PAIRS_AT_ONCE):
                    part = np.flatnonzero(use)[m : m + PAIRS_AT_ONCE]
                    for to, z in zip((ii, jj), found(x, codes, bucket, i[part], j[part]), strict=True):
                        to.append(z)
        none = np.empty(0, int)
        return np.concatenate([none, *ii]), np.concatenate([none, *jj])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _with_end(batches):
            now = pa.Table.from_batches([batch]) if batch is not None else None
            table = now if kept is None else kept if now is None else pa.concat_tables([kept, now])
            if table is None:
                return
            table = table.combine_chunks()
            bucket, block, dim = (table.column(c).to_numpy() for c in ("bucket", "block", "dim"))
            label = table.column("label_hash").to_numpy()
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]) | (dim[1:] != dim[:-1]) | (label[1:] != label[:-1])
            starts = np.flatnonzero(new)
            stop = len(bucket) if now is None else starts[-1]  # the last block may go on in the next batch
            kept = table.slice(stop) if now is not None else None
            starts = starts[starts < stop]
            if not len(starts):
                continue
            ends = np.append(starts[1:], stop)
            side, inside = table.column("side").to_numpy(), table.column("inside").to_numpy(zero_copy_only=False)
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            for d in np.unique(dim[starts]):
                these = dim[starts] == d
                rows = np.flatnonzero(dim[:stop] == d)
                lo, hi = np.searchsorted(rows, starts[these]), np.searchsorted(rows, ends[these])
                part = table.take(pa.array(rows))
                i, j = links(_matrix(part.column("v")), _matrix(part.column("codes")), bucket[rows], side[rows], inside[rows], lo, hi)
                if not len(i):
                    continue
                i, j = rows[i], rows[j]
                names, place = np.unique(node[np.concatenate([i, j])], return_inverse=True)
                a, b = place[: len(i)], place[len(i) :]
                sums = np.zeros(len(names), np.int64)
                np.add.at(sums, a, n[j])
                np.add.at(sums, b, n[i])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums), pa.array(names[_roots(len(names), a, b)])], ["node", "links", "root"])

    keys = ["label_hash", "dim", "bucket", "block"]
    sent = blocks.withColumn("label_hash", F.xxhash64("label")).select(*keys, "side", "inside", "node", "n", "v", "codes")
    return sent.repartition(partitions(blocks.sparkSession), *keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(run, "node long, links long, root long")


def near_duplicate_vectors(
    vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: int = TABLES, axes: int = AXES, probes: int = PROBES, chunk: int = CHUNK,
) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they have as many components, and their cosine, in double
    precision, is at least least. Vectors that are null, empty or zero or hold a null or a value that is not finite
    link with nothing. Equal vectors are one until the end (their cosine is 1), so copies of one vector are counted, not compared.
    Every link found is exact; a pair at the least cosine is missed with the probability that
    TABLES states. A null vec_id counts as a vector and names no component while others have ids. Repeated rows are copies.
    """
    rows, reps = representatives(vectors, id_col, vector_col, label_col)
    codes = written(coded(reps, tables, axes, probes), "vector-codes")
    met = written(linked(in_blocks(codes, chunk), least, probes), "vector-links")
    links = met.groupBy(F.col("node").alias("of_node")).agg(F.sum("links").alias("links"))
    group = connected_components(met.filter("node <> root").select("node", "root"), "node", "root").select(F.col("node").alias("in_node"), "component")
    owned = written(reps.select("label", "h", "g", "node", "n", "least").join(links, F.col("node") == F.col("of_node"), "left").join(group, F.col("node") == F.col("in_node"), "left"), "vector-nodes")
    owned = owned.withColumn("component", F.coalesce("component", "node"))
    heads = owned.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component_id"))
    owned = join_groups(owned.select("component", "label", "h", "g", "node", F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links")), heads, ["component"], ["node"])
    owned = written(owned.select("label", "h", "g", F.col("copies").alias("n"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id"), "vector-results")
    told = join_groups(rows.filter("h is not null"), owned, ["label", "h", "g"], ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
