"""Repeated passages by level-wise doubling (8).

Windows repeated at one length alone are extended to twice that length: words / 4, words / 2, words. Of the
shortest windows only anchors take part, the one with the smallest hash in each window of full length: a
passage that repeats has the same anchors wherever it stands, so none is lost and a tenth of the rows is
moved. Longer windows are hashed for survivors alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.llm.common import join_groups, slices, written
from alertmill.llm.textops import code_points, ranges, span_hashes, word_spans

#: Words of a passage that may not start twice.
WORDS = 20
_PLACES = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("pos", T.IntegerType(), False), T.StructField("h", T.LongType(), False)])


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over values[i : i + width], by doubling."""
    have = 1
    while have * 2 <= width:
        values = of(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return of(values[:-rest], values[rest:]) if rest else values


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, offsets = code_points(texts)
    starts, ends, first = word_spans(points, offsets)
    return span_hashes(points, starts, ends), first


def anchors(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position and hash of the words // 4 words at each anchor."""
    word, first = _words(texts)
    gram, span = words // 4, words - words // 4 + 1
    n = len(word) - gram + 1
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n)
    h = span_hashes(word, at, at + gram)
    low = _sliding(h, span, np.minimum)  # of each full window
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    low[np.arange(len(low)) + words > first[1:][text[: len(low)]]] = 0  # not inside one text
    # the largest minimum of the windows that hold a position: its own hash, if it is the smallest of one
    pad = np.zeros(span - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), span, np.maximum)
    place = np.flatnonzero((high == h) & (h != 0))
    return text[place], place - first[text[place]], h[place]


def _starts(positions: list[int], n_words: int, length: int, last: bool) -> np.ndarray:
    """Starts of windows of twice the length around repeated ones: to the right and to the left, or (last) all that hold one."""
    shifts = np.arange(length + 1) if last else np.array([0, length])
    found = np.unique((np.asarray(positions, np.int64)[:, None] - shifts).reshape(-1))
    return found[(found >= 0) & (found + 2 * length <= n_words)]


def _extended(texts: list[str], positions: list[list[int]], length: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position and two hashes (64 and, for the last ones, 32 bits) of those windows."""
    word, first = _words(texts)
    own = [_starts(p, int(n), length, last) for p, n in zip(positions, np.diff(first), strict=True)]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in own])
    pos = np.concatenate(own) if own else np.empty(0, np.int64)
    start = pos + first[text]
    g = (span_hashes(word, start, start + 2 * length, base=1) >> np.uint64(32)).astype(np.uint32) if last else np.empty(0, np.uint32)
    return text, pos, span_hashes(word, start, start + 2 * length), g


def _repeated(rows: DataFrame) -> DataFrame:
    """key and its positions (pos) whose hash stands in more than one row; further places by a false hash do no harm. Counts are combined before the shuffle."""
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return rows.join(many, "h").groupBy("key").agg(F.collect_set("pos").alias("pos"))


def repeated_windows(docs: DataFrame, words: int = WORDS, small: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Where windows of words words may start elsewhere too, and which of those start first. docs: key, id, text and more.

    Each level takes all columns of docs, so that one exchange of the texts serves them all.

    The first table has key and pos, the starts of repeated windows of words / 2 words: a window of full
    length that repeats holds one (small: see _small_ids). The second has id and firsts: of each such window that is hashed (by 96
    bits, as this alone decides), the place with the smallest id, then position. All other places start earlier too. Also: words / 2.
    """
    length = words // 4
    kind = docs.schema["id"].dataType.simpleString()

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text, pos, h = anchors(part.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(text)), pa.array(pos, pa.int32()), pa.array(h.view(np.int64))], names=["key", "pos", "h"])

    def next_level(length: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = "id" if last else "key"
            for part in slices(batches):
                text, pos, h, g = _extended(part.column("text").to_pylist(), part.column("pos").to_pylist(), length, last)
                more = [pa.array(g.view(np.int32))] if last else []
                yield pa.RecordBatch.from_arrays([part.column(of).take(pa.array(text)), pa.array(pos, pa.int32()), pa.array(h.view(np.int64)), *more], names=[of, "pos", "h", *(["g"] if last else [])])

        return run

    found = _repeated(docs.mapInArrow(first_level, _PLACES))
    while 2 * length < words:
        found, length = _repeated(docs.join(found, "key").mapInArrow(next_level(length, False), _PLACES)), 2 * length
    rows = docs.join(found, "key").mapInArrow(next_level(length, True), f"id {kind}, pos int, h long, g int")
    if kind != "bigint":
        first, unpacked = F.struct("id", "pos"), [F.col("first.id").alias("id"), F.col("first.pos").alias("pos")]
    elif small:  # a place as one number, by id and then by position, so that the smallest is found by plain sums in tasks
        first = F.col("id") * (1 << 27) + F.col("pos")
        unpacked = [F.expr("first div (1L << 27)").alias("id"), F.expr("cast(first & ((1L << 27) - 1) as int)").alias("pos")]
    else:
        first = (F.col("id").cast("decimal(20,0)") * (1 << 31) + F.col("pos")).cast("decimal(38,0)")
        unpacked = [F.expr("cast(floor(first / 2147483648) as bigint)").alias("id"), F.expr("cast(pmod(first, 2147483648) as int)").alias("pos")]
    firsts = rows.groupBy("h", "g").agg(F.min(first).alias("first")).select(*unpacked)
    return found, firsts.groupBy("id").agg(F.collect_set("pos").alias("firsts")), length


def _small_ids(docs: DataFrame) -> bool:
    """Whether all ids have 36 bits and all texts fewer than 2 ** 27 characters, so that a place fits 64 bits."""
    if docs.schema["id"].dataType != T.LongType():
        return False
    r = docs.agg(F.min("id"), F.max("id"), F.max(F.octet_length("text"))).first()
    return r[0] is not None and r[0] >= 0 and r[1] < 1 << 36 and r[2] < 1 << 27


def without_repeated_passages(docs: DataFrame, words: int = WORDS, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space; digest: kept_sha256 instead) and rest (the other columns, in a struct).

    A word goes if it is in a window of words words that also starts earlier. Words are runs without ASCII
    white space, unchanged. Texts are judged as they are, not by what is left of them. Null and empty texts
    have no words. Rows that agree in doc_id and text are one document with one result; of different texts
    under one doc_id equal windows at equal positions all stay. A null doc_id is the smallest. Ids that are no
    integers are ordered as text. An extra column never clashes, as it is inside rest. words must be a multiple of 4.
    """
    if words % 4:
        raise ValueError("words must be a multiple of 4")
    others = [docs[c] for c in docs.columns if c not in (id_col, text_col)]
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *([] if digest else others)).alias("rest"))
    # a null is the smallest; an id of text has a mark before it
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    base = base.select(F.xxhash64(F.lit(17), "doc_id", "text").alias("key"), "doc_id", order.alias("id"), "text", "rest")
    # copies of a whole text that are not its first row: all of their windows start earlier
    named = base.select("key", "id", F.xxhash64(F.lit(1), "text").alias("t"), F.hash(F.lit(2), "text").alias("u"))
    heads = named.groupBy("t", "u").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # by key alone, as texts are dealt by it once for all levels; rows of one key tell their ids apart inside
    copies = written(join_groups(named, heads, ["t", "u"], ["key", "id"]).filter("id <> head").groupBy("key").agg(F.collect_set("id").alias("copies")), "passage-copies")
    # dealt even where copies are few: sent to all tasks, texts would be dealt after this join, once with whole copies and once without
    tagged = base.join(copies.hint("merge"), "key", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.col("id")), F.lit(False))).drop("copies")
    own = tagged.filter("not copy")
    found, firsts, half = repeated_windows(own, words, _small_ids(base))
    ids = base.select("key", "id").distinct().join(firsts, "id").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("id", "firsts"))).alias("by_id"))
    joined = tagged.join(found, "key", "left").join(ids, "key", "left").withColumn("firsts", F.col("by_id")[F.col("id")]).drop("by_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gone, kept = [], [], []
            for text, copy, pos, first in zip(*[part.column(c).to_pylist() for c in ("text", "copy", "pos", "firsts")], strict=True):
                have = text.encode("utf-8", "surrogatepass").split()  # ASCII white space
                left = have
                if copy and len(have) >= words:
                    left = []
                elif pos:
                    at = np.setdiff1d(_starts(pos, len(have), half, True), np.asarray(first or [], np.int64), assume_unique=True)
                    cover = np.zeros(len(have) + 1, np.int64)
                    cover[at] += 1
                    cover[at + words] -= 1
                    left = [have[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                n.append(len(have))
                gone.append(len(have) - len(left))
                kept.append(b" ".join(left))
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), last, part.column("rest")], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text", "rest"])

    rest = base.schema["rest"].dataType.simpleString()
    kind = base.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string, rest {rest}")
