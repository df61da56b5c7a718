"""Document fingerprints from closed syncmers (5).

A k-mer of characters is a closed syncmer if the smallest of its inner s-mers (by hash) is its first or its
last one. That depends on the k-mer alone, so equal passages give equal anchors wherever they stand.

Two texts are compared by all of their anchors, aligned in the order of their positions. A fingerprint is a
short sketch of the same anchors for output.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import partitions, slices
from alertmill.llm.textops import code_points, mix, span_hashes

#: Characters of a k-mer and of its inner substrings, and anchors that a fingerprint (not the alignment) keeps.
K, S, KEEP = 16, 6, 128


def syncmers(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and 64-bit hash of each closed syncmer."""
    points, offsets = code_points(texts)
    n = len(points)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n - s + 1)
    inner = span_hashes(points, at, at + s)
    # smallest of the k - s + 1 inner hashes from each position on, by doubling
    width, low = 1, inner
    span = k - s + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    m = n - k + 1
    low = low[:m]
    closed = (inner[:m] == low) | (inner[k - s : k - s + m] == low)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(texts)), sizes)[:m]
    closed &= np.arange(m) + k <= offsets[1:][text]  # inside one text
    place = np.flatnonzero(closed)
    return text[place], place - offsets[text[place]], span_hashes(points, place, place + k, base=1)


def _own_hash(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def anchors_and_sketches(texts: list[str], keep: int = KEEP, k: int = K, s: int = S) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All anchors of each text by position (64 bits each), and its keep smallest distinct ones (32 bits each).

    A text without anchors has its own hash as one; an empty text none.
    """
    text, _, whole = syncmers(texts, k, s)  # by text, then by position
    borders = np.searchsorted(text, np.arange(len(texts) + 1))
    found = (mix(whole) >> np.uint64(32)).astype(np.int64)
    order = np.unique((text.astype(np.int64) << 32) | found)  # by text, then by hash
    first = np.searchsorted(order, np.arange(len(texts) + 1, dtype=np.int64) << 32)
    anchors, out = [], []
    for i, t in enumerate(texts):
        placed = whole[borders[i] : borders[i + 1]]
        mine = order[first[i] : min(first[i + 1], first[i] + keep)] & 0xFFFFFFFF
        if not len(placed) and t:
            mine = np.array([_own_hash(t)], np.int64)
            placed = mine.astype(np.uint64)
        anchors.append(placed)
        out.append(mine[:keep])
    return anchors, out


def sketches(texts: list[str], keep: int = KEEP, k: int = K, s: int = S) -> list[np.ndarray]:
    """The keep smallest distinct anchors of each text, 32 bits each. A text without anchors has its own hash as one; an empty text none."""
    return anchors_and_sketches(texts, keep, k, s)[1]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """How many anchors can be matched in the order of their positions: the longest common subsequence, exactly."""
    n = min(len(a), len(b))
    differs = a[:n] != b[:n]
    head = int(differs.argmax()) if differs.any() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    tail = int(differs.argmax()) if differs.any() else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    both = np.intersect1d(a, b) if len(a) and len(b) else a[:0]
    if not len(both):
        return head + tail
    x, y = (np.searchsorted(both, z[np.isin(z, both)]) for z in (a, b))
    pairs = int(np.bincount(x, minlength=len(both)) @ np.bincount(y, minlength=len(both)))
    return head + tail + (_by_pairs(x, y) if pairs <= 16 * (len(x) + len(y)) else _by_bits(x, y))


def _by_pairs(x: np.ndarray, y: np.ndarray) -> int:
    """Hunt and Szymanski's: the longest rising run of pairs; for few pairs."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    ends: list[int] = []
    for v in x.tolist():
        for j in reversed(places[v]):
            at = bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
            else:
                ends[at] = j
    return len(ends)


def _by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """The bit-parallel one, a row of the table as one number; for texts that repeat themselves."""
    masks: dict[int, int] = {}
    for v in np.unique(x):
        masks[int(v)] = int.from_bytes(np.packbits(x == v, bitorder="little").tobytes(), "little")
    full = (1 << len(x)) - 1
    row = full
    for v in y.tolist():
        hit = row & masks[v]
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's of two texts' anchors, where those count as common that are aligned. Two empty ones: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = aligned(a, b)
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (8 hexadecimal digits an anchor) of each row, in one pass. Null: empty, and an empty fingerprint."""
    narrow = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([as_text(x) for x in sketches(part.column("text").to_pylist(), keep)], pa.string())], names=["doc_id", "fingerprint"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _splitters(rows: DataFrame, column: str, n: int) -> list:
    """At most n - 1 values, of any type, that cut the rows' values into ranges of like size: the largest of each of Spark's own sampled ranges but the last."""
    ranges = rows.select(column).repartitionByRange(n, column).groupBy(F.spark_partition_id().alias("range")).agg(F.max(column).alias("v"))
    return sorted({r["v"] for r in ranges.collect()})[:-1]  # a row for each range


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ahead, part: rows in descending doc_id inside each part; a row with ahead stands for the next part's first.

    Parts are ranges of ids from sampled splitters (as many as there are shuffle partitions), so one shuffle
    lays each document beside the next. A part's first row is also sent to the part before it, and the very
    first to the last; that doubles at most one row for each part. Ids have any type that is ordered; whole numbers
    come out as long. Equal ids are ordered by text; null ids come last, and are cut into parts by their texts' beginnings.
    """
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    narrow = docs.select((docs[id_col].cast("long") if whole else docs[id_col]).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    if whole:
        cuts = sorted({int(x) for x in narrow.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    else:
        cuts = _splitters(narrow.filter("doc_id is not null"), "doc_id", n)
    part = F.lit(len(cuts)) - _below(F.col("doc_id"), cuts)  # 0: the largest ids
    begins = F.substring("text", 1, 64)
    unnamed = narrow.filter("doc_id is null")
    text_cuts = [] if unnamed.select("doc_id").isEmpty() else _splitters(unnamed.select(begins.alias("begins")), "begins", n)
    placed = narrow.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + _below(begins, text_cuts)).otherwise(part).cast("int"))
    tops = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row for each part
    have = sorted(tops)
    before = {p: have[i - 1] for i, p in enumerate(have)}  # the first part's is the last one
    if not have:
        return placed.withColumn("ahead", F.lit(False))
    ahead = docs.sparkSession.createDataFrame([(p, tops[p], before[p]) for p in have], f"part int, top {narrow.schema['doc_id'].dataType.simpleString()}, to int")
    firsts = placed.join(F.broadcast(ahead), "part").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    # several rows may share the top id: the first of them by text
    firsts = firsts.groupBy("part", "to").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("r")).select("r.doc_id", "r.text", F.col("to").alias("part"), F.lit(True).alias("ahead"))
    rows = placed.withColumn("ahead", F.lit(False)).unionByName(firsts)
    return rows.repartitionById(len(cuts) + len(text_cuts) + 2, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")


def _below(value: Column, cuts: list) -> Column:
    """The number of cuts below a value, by halving."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(value > F.lit(cuts[m]), F.lit(m + 1) + _below(value, cuts[m + 1 :])).otherwise(_below(value, cuts[:m]))


def edited_likeness(docs: DataFrame, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and its likeness to the edited text and to the next one by all aligned anchors.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A single row is its own next.
    """

    def results(rows: list[tuple], nexts: list[str]) -> pd.DataFrame:
        own = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(own, nexts, strict=True)]
        # the last row's next is not among the rows themselves
        (a, short), (b, short_edited) = anchors_and_sketches([*own, nexts[-1]], keep), anchors_and_sketches(edited, keep)
        return pd.DataFrame(
            {
                "n_chars": [len(t) for t in own],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [as_text(x) for x in short[:-1]], "edited_fingerprint": [as_text(x) for x in short_edited],
                "near_edited": [likeness(x, y) for x, y in zip(a, b, strict=False)], "near_next": [likeness(x, y) for x, y in zip(a, a[1:], strict=False)],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []  # rows of a part whose next is known, and the last one, whose next comes
        size = 0
        for batch in slices(batches):
            for p, i, t, ahead in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "ahead")], strict=True):
                if p != part:
                    part, held, size = p, [], 0
                if held and (ahead or size > 1_000_000):
                    yield pack(held, results(held, [*[r[1] for r in held[1:]], t]), batch.column("doc_id").type)
                    held, size = [], 0
                if not ahead:
                    held.append((i, t))
                    size += len(t)
        assert not held, "a part ends with the row of the next one"

    def pack(rows: list[tuple], found: pd.DataFrame, kind: pa.DataType) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pandas(found, preserve_index=False)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *made.columns], names=["doc_id", *made.schema.names])

    rows = beside_next(docs, id_col, text_col).select("part", "doc_id", "text", "ahead")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
