"""Near duplicates by DartMinHash signatures, banded joins and exact checks (2).

A document is the multiset of its runs of five words: each run has its number of occurrences as weight.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import join_groups, partitions, row_key, sent_if_small, slices, texts, written
from alertmill.llm.textops import code_points, mix, ranges, span_hashes, windows, word_spans
from alertmill.operators.components import connected_components

#: Words of a shingle and the least similarity (weighted Jaccard) of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands of a signature and coordinates of a band: a pair of similarity 0.8 shares no band once in 10 million times.
BANDS, COORDINATES = 32, 4
#: Ranks (in darts for each unit of weight) of the first slab end at 2 ** FIRST_SLAB; each later slab doubles.
FIRST_SLAB = -7
#: Members of a chunk of a bucket; two chunks are compared in one task.
BLOCK = 512
#: Rows to be dropped up to which their keys are sent to all tasks; more are joined.
SENT_ROWS = 1_000_000

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def cells(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit cells of weight: text and 64-bit name of each (shingle, n-th occurrence); and two hashes of each text's words.

    A text of fewer words is one shingle; one without words has none.
    """
    points, offsets = code_points(texts)
    starts, ends, first = word_spans(points, offsets)
    word = span_hashes(points, starts, ends)
    a, b, text = windows(word, first, words, whole_if_short=True)
    shingle = span_hashes(word, a, b)
    whole, check = (span_hashes(word, first[:-1], first[1:], base=b) for b in (1, 0))
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    nth = ranges(np.diff(np.append(at, len(text)))).astype(_U)
    return text, mix(shingle + nth * _U(0x9E3779B97F4A7C15)), whole, check


@functools.cache
def _poisson(mean: float) -> np.ndarray:
    """The distribution function at 0, 1, 2, ..."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])))


def dart_signatures(text: np.ndarray, cell: np.ndarray, n_texts: int, size: int = BANDS * COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, for each text with cells (others: all ones).

    Darts are thrown by hash into (cell, slab of ranks): as many as a Poisson number with the slab's width as
    mean, each with a coordinate and a rank inside the slab. A text throws slab after slab until each of its
    coordinates is hit, so the work follows the sum of its weights only as far as one hash for each cell.
    Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    out = np.full(n_texts * size, _NONE)
    slab = 0
    while len(text):
        width = 2.0**FIRST_SLAB if slab == 0 else 2.0 ** (FIRST_SLAB + slab - 1)
        seed = mix(cell ^ mix(np.array([slab + 1], _U)))
        thrown = np.searchsorted(_poisson(width), (seed >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(thrown)
        n = thrown[hit]
        dart = mix(np.repeat(seed[hit], n) + (ranges(n).astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
        at = np.repeat(text[hit], n) * size + (dart % _U(size)).astype(np.int64)
        np.minimum.at(out, at, (_U(slab) << _U(56)) | (dart >> _U(8)))
        open_ = (out.reshape(n_texts, size) == _NONE).any(axis=1)[text]
        text, cell, slab = text[open_], cell[open_], slab + 1
    return out.reshape(n_texts, size)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the row), node and check (hashes of its words) and bands (hashes; empty for a text without words)."""
    narrow = texts(docs, id_col=id_col, text_col=text_col).withColumn("key", row_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = part.num_rows
            text, cell, whole, check = cells(part.column("text").to_pylist())
            flat = dart_signatures(text, cell, n).reshape(-1)
            starts = np.arange(n * BANDS) * COORDINATES
            band = span_hashes(flat, starts, starts + COORDINATES) + np.tile(mix(np.arange(BANDS)), n)
            have = np.zeros(n, bool)
            have[text] = True
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(have * BANDS)]).astype(np.int32), pa.array(mix(band).reshape(n, BANDS)[have].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), lists], names=["doc_id", "key", "node", "check", "bands"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, key long, node long, check long, bands array<long>")


def node_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, check and cells (64 bits each, sorted) of each row."""
    narrow = texts(docs, id_col=id_col, text_col=text_col).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text, cell, whole, check = cells(part.column("text").to_pylist())
            order = np.lexsort((cell, text))
            sorted_, at = cell[order], np.searchsorted(text[order], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), pa.array([sorted_[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], names=["node", "check", "cells"])

    return narrow.mapInArrow(run, "node long, check long, cells binary")


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows whose nodes are made anew from both hashes where different words fell on one node; clashes: those nodes (None: there is none)."""
    if clashes is None:
        return rows
    joined = rows.join(clashes.select("node", F.lit(True).alias("clash")), "node", "left")
    return joined.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(*rows.columns)


def _similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, cells_a, cells_b) whose weighted Jaccard similarity is at least SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ("cells_a", "cells_b")):
            keep = []
            for x, y in zip(part.column("cells_a").to_pylist(), part.column("cells_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = sorted((len(x), len(y)))
                same = len(np.intersect1d(x, y, assume_unique=True)) if small >= SIMILARITY * large else 0
                keep.append(same >= SIMILARITY * (len(x) + len(y) - same))
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def links(members: DataFrame, content: DataFrame) -> DataFrame | None:
    """node, component of the nodes with a link (None: there is no link); members: bucket, node, n (of the bucket); content: node, cells.

    Two rounds, and no pair is made into a row before it is known to be similar. First each bucket's members
    are compared with one of them, the one that meets most others in all its buckets: copies of one text
    fall into its class at once. Buckets that still hold several classes are then compared in full, but for
    pairs inside one class, inside tasks, by blocks of two chunks; a block returns a tree of links and no more.
    So no link between classes is lost, no task holds a whole bucket, and a large class costs its own size for
    each chunk of others.
    """
    hub = members.groupBy("node").agg(F.sum("n").alias("hub"))
    sized = written(members.join(hub, "node"), "near-sized")
    pivots = sized.groupBy("bucket").agg(F.max_by("node", F.struct("hub", "node")).alias("pivot"), F.count(F.lit(1)).alias("n"))
    pairs = join_groups(sized.select("bucket", "node"), pivots, ["bucket"], ["node"]).filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    wide = pairs.join(content.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a").join(content.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b")
    found = written(_similar(wide.select("a", "b", "cells_a", "cells_b")), "near-links")
    classes = None if found.isEmpty() else connected_components(found)
    now = sized.withColumn("component", F.col("node")) if classes is None else sized.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = written(now.select("bucket", "node", "component"), "near-classes")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").select("bucket", "n")
    rows = written(join_groups(now, mixed, ["bucket"], ["node"]), "near-mixed")
    if rows.isEmpty():
        return classes
    more = written(_block_links(rows, content), "near-links")
    if more.isEmpty():
        return classes
    return connected_components(found.unionByName(more))


def chunk_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (bucket, node, component) with the chunk of each, and the pairs (bucket, chunk, other, block) of chunks to be compared.

    A class of BLOCK members or more of a bucket has chunks of its own, about BLOCK members each, that are not
    compared with each other; the smaller ones share chunks, which are compared with themselves too.
    """
    of_class = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.col("n") >= BLOCK)
    shared = of_class.filter("not own").groupBy("bucket").agg(F.sum("n").alias("n_shared"))
    plan = of_class.join(shared, "bucket", "left").withColumn("parts", F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("n_shared")) / BLOCK).cast("int"))
    plan = written(plan.select("bucket", "component", "own", "parts", "n"), "near-plan")
    part = F.when(F.col("own"), F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64(F.lit(8), "component"), F.col("parts"))).cast("int")
    name = lambda c, p: F.xxhash64("bucket", F.when(F.col("own"), c), p)
    placed = join_groups(rows, plan, ["bucket", "component"], ["node"]).withColumn("part", part)
    placed = placed.select("bucket", "node", "component", name(F.col("component"), F.col("part")).alias("chunk"))
    kinds = plan.select("bucket", "own", F.when(F.col("own"), F.col("component")).alias("class"), "parts").distinct()
    chunks = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "own", "class", name(F.col("class"), F.col("part")).alias("chunk"))
    other = chunks.select("bucket", F.col("own").alias("_own"), F.col("class").alias("_class"), F.col("chunk").alias("other"))
    pairs = chunks.join(other, "bucket").filter(~(F.col("own") & F.col("_own") & (F.col("class") == F.col("_class"))))
    return placed, pairs.select("bucket", "chunk", F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"))


def _block_links(rows: DataFrame, content: DataFrame) -> DataFrame:
    """a, b: links that join the components of each block's members. rows: bucket, node, component."""
    placed, pairs = chunk_pairs(rows)
    # a chunk has some BLOCK members
    full = placed.join(pairs, ["bucket", "chunk"]).select("block", "node", "component").join(content, "node").select("block", "node", "component", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for part in slices(batches, "cells"):
            for b, *row in zip(*[part.column(x).to_pylist() for x in ("block", "node", "component", "cells")], strict=True):
                if b != block:
                    yield from _tree(held)
                    block, held = b, []
                held.append(row)
        yield from _tree(held)

    dealt = full.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long")


def _tree(held: list[list]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of a block's members by products of their incidence matrix, a few columns at a time."""
    if len(held) < 2:
        return
    sizes = np.array([len(r[2]) // 8 for r in held])
    member = np.repeat(np.arange(len(held)), sizes)
    _, column, times = np.unique(np.frombuffer(b"".join(r[2] for r in held), "<u8"), return_inverse=True, return_counts=True)
    shared = times > 1
    column, member = (np.cumsum(shared) - 1)[column[shared[column]]], member[shared[column]]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    same = np.zeros((len(held), len(held)), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(column, [low, low + 2048])
        x = np.zeros((len(held), 2048), np.float32)
        x[member[i:j], column[i:j] - low] = 1
        same += x @ x.T
    near = np.triu(same >= SIMILARITY * (sizes[:, None] + sizes[None, :] - same), 1)
    names = [r[1] for r in held]
    parent = {c: c for c in names}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(names[i]), root(names[j])
        if a != b:
            parent[a] = b
            out.append((held[i][0], held[j][0]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, class_id (smallest doc_id of the class), class_size and kept (one row of each class) for each row.

    Rows of equal words are one node from the start, so copies meet no join. Classes are the components of
    the links between nodes. A text without words is near other such texts alone; null text is empty; null
    ids are the largest. Repeated rows (one id, one text) are all kept or all not.
    """
    rows = written(signatures(docs, id_col, text_col), "near-signatures")
    clashes = written(rows.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least <> most").select("node"), "near-clashes")
    clashes = None if clashes.isEmpty() else clashes
    rows = told_apart(rows, clashes)
    nodes = rows.groupBy("node").agg(F.any_value("bands").alias("bands"))
    buckets = written(nodes.select("node", F.explode("bands").alias("bucket")), "near-buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(join_groups(buckets, shared.withColumn("size", F.col("n")), ["bucket"], ["node"]).withColumnRenamed("size", "n"), "near-members")
    involved = members.select("node").distinct()
    content = told_apart(node_cells(docs, id_col, text_col), clashes).join(involved, "node", "left_semi")
    classes = links(members, written(content.groupBy("node").agg(F.min("cells").alias("cells")), "near-content"))
    named = rows.select("doc_id", "key", "node")
    if classes is not None:
        # a node may be a text of any share of the rows
        of = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(classes, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
        named = join_groups(named, of, ["node"], ["key"])
    else:
        named = named.withColumn("component", F.col("node"))
    named = written(named.select("doc_id", "key", "component"), "near-named")
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head"), F.count(F.lit(1)).alias("class_size")).withColumn("n", F.col("class_size"))
    joined = join_groups(named, heads, ["component"], ["key"])
    return joined.select("doc_id", "key", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each class, with all their columns, whatever their names."""
    gone = written(near_duplicates(docs, id_col, text_col).filter("not kept").select("doc_id", "key").distinct(), "near-gone")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("all"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).select("all", "doc_id", row_key().alias("key"))
    gone = sent_if_small(gone, SENT_ROWS)
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["key"] == gone["key"]), "left_anti").select("all.*")
