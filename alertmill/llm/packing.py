"""Mixture-controlled packing of documents into sequences of tokens (7).

Each source is a queue of its documents' tokens, and every window (sequence) takes from each queue its target
proportion: given targets, or the queue's share of all tokens. A round credits each queue its proportion of
the window; in turn, each sends the whole tokens of its own credit and of the deficit that the queues before
it left, and the last window's deficits are carried on. So a window is filled exactly, and after any window a
queue is less than one token from its target. As the sums of deficits follow from the window's number, any
task knows where its documents' tokens go without running the windows before: nothing is gathered. A queue
that ends early leaves its proportion to the others, in a new phase.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm import bpe
from alertmill.llm.common import sent_if_small, slices, written
from alertmill.llm.textops import ranges

#: Tokens of a sequence, and the id that ends each document.
SEQUENCE, END_ID = 2048, 1
#: Longer texts are encoded in fragments of about so many characters.
FRAGMENT_CHARS = 16_384
#: Bytes of ids that are cut into pieces at once.
SLICE_IDS = 2_000_000
#: Tokens of each window that a queue of its own has at least; smaller sources share the first queue.
LEAST_TOKENS = 2
#: Places of (source, part) up to which they are sent to all tasks; more are joined.
SENT_PLACES = 1_000_000


class Phase(NamedTuple):
    """Windows from the first one on in which the same queues are open; before and weights: sums over the earlier queues (one more entry: all)."""

    first: int
    before: list[int]
    weights: list[int]
    left: int


def _running(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def _dealt(tokens: int, weights: list[int]) -> list[int]:
    """What each queue has sent of that many tokens: deficits go from queue to queue, so only sums are rounded."""
    sums = _running(weights)
    marks = [tokens * x // sums[-1] for x in sums]
    return [b - a for a, b in zip(marks, marks[1:], strict=False)]


def phases(totals: list[int], weights: list[int], length: int) -> list[Phase]:
    """The phases of all windows. A window in which a queue ends is a phase of its own: the queue gives its rest, the others fill it up."""
    sent, window, out = [0] * len(totals), 0, []
    while sent != totals:
        rest = [t - s for t, s in zip(totals, sent, strict=True)]
        open_ = [w if r else 0 for w, r in zip(weights, rest, strict=True)]
        if not any(open_):
            open_ = rest
        left = sum(rest)

        def fits(n: int, open_=open_, rest=rest, left=left) -> bool:
            return all(a <= b for a, b in zip(_dealt(min(n * length, left), open_), rest, strict=True))

        low, high = 0, -(-left // length)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(middle) else (low, middle - 1)
        if low:
            out.append(Phase(window, _running(sent), _running(open_), left))
            sent = [s + d for s, d in zip(sent, _dealt(min(low * length, left), open_), strict=True)]
            window += low
            continue
        gives, need = [0] * len(totals), min(length, left)
        while need:
            if not any(open_):  # queues without a target follow when all others have ended
                open_ = [r - g for r, g in zip(rest, gives, strict=True)]
            more = [min(d, r - g) for d, r, g in zip(_dealt(need, open_), rest, gives, strict=True)]
            gives = [g + m for g, m in zip(gives, more, strict=True)]
            need -= sum(more)
            open_ = [w if g < r else 0 for w, g, r in zip(open_, gives, rest, strict=True)]
        out.append(Phase(window, _running(sent), _running(gives), sum(gives)))
        sent = [s + g for s, g in zip(sent, gives, strict=True)]
        window += 1
    return out


def sent(windows: np.ndarray, queue: int, plan: list[Phase], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that the queues before this one, and this one, have sent before each window (windows: rising)."""
    ahead, own = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    first = [p.first for p in plan]
    of = np.maximum(np.searchsorted(first, windows, side="right") - 1, 0)
    for i in np.unique(of):
        here, (start, before, weights, left) = np.flatnonzero(of == i), plan[i]
        small = left.bit_length() + weights[-1].bit_length() < 63  # products fit
        tokens = np.minimum((windows[here] - start).astype(np.int64 if small else object) * length, left)
        a, b = (before[q] + tokens * weights[q] // weights[-1] for q in (queue, queue + 1))
        ahead[here], own[here] = a, b - a
    return ahead, own


def window_at(token: int, queue: int, plan: list[Phase], length: int) -> int:
    """The last window before which the queue has sent no more than that many tokens: a close guess, since it is off its target by less than a token."""
    starts = [p.before[queue + 1] - p.before[queue] for p in plan]
    p = plan[bisect_right(starts, token) - 1]
    low, high, all_ = p.weights[queue], p.weights[queue + 1], p.weights[-1]
    last, need = -(-p.left // length), token - (p.before[queue + 1] - p.before[queue])
    if high == low:
        return p.first + last
    if not low:  # the first queue may send less than a token a window
        return p.first + min(last, -(-(need + 1) * all_ // (high * length)) - 1)

    def sent_before(j: int) -> int:
        tokens = min(j * length, p.left)
        return tokens * high // all_ - tokens * low // all_

    j = min(last, max(0, need * all_ // ((high - low) * length) - 1))
    while j and sent_before(j) > need:
        j -= 1
    while j < last and sent_before(j + 1) <= need:
        j += 1
    return p.first + j


def _tokens(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, ids (16 bits each if the vocabulary allows), n, part, and before: tokens of the source earlier in the part."""
    narrow = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        kind = "<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4"
        part, so_far = TaskContext.get().partitionId(), {}
        for rows in slices(batches):
            ids, n, before = [], [], []
            for text, source in zip(rows.column("text").to_pylist(), rows.column("source").to_pylist(), strict=True):
                own = np.append(coder.encode_fragments(text, FRAGMENT_CHARS), np.uint32(end_id)).astype(kind)
                ids.append(own.tobytes())
                n.append(len(own))
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + len(own)
            size = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(np.full(size, part, np.int64)), pa.array(before, pa.int64())], names=["doc_id", "source", "ids", "n", "part", "before"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, source string, ids binary, n long, part long, before long")


def packed(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: Mapping[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document inside a sequence.

    doc_id, start (tokens of the document before), length, ids_crc32, doc_tokens, sequence_id, offset, source
    and ids (array<int>; not without with_ids). Null and empty texts are their end id alone; null sources are
    the empty one; repeated rows are packed as often as they stand; extra columns are not read.

    targets: the proportion of each window that a source has, 1 in all at most; the sources it does not name
    share what it leaves, by their tokens (nothing: they follow the named ones). None: each source has its share
    of all tokens, so that no queue ends early. Sources below LEAST_TOKENS tokens a window share a queue, the first.
    """
    path = vocabulary or bpe.default_vocabulary()
    tokens = written(_tokens(docs, path, end_id, id_col, text_col, source_col), "packing-tokens")
    sums = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-sums")
    names, totals, weights = _queues(sums, length, dict(targets or {}))
    plan = phases(totals, weights, length)
    queues = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(names, 1)), "queue int, source string"))
    placed = sums.join(queues, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(0)))
    in_part = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    of_queue = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("queue", "part").agg(F.sum("n").alias("n")).select("queue", "part", F.coalesce(F.sum("n").over(of_queue), F.lit(0)).alias("base"))
    bases = placed.withColumn("inside", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(parts, ["queue", "part"]).select("source", "part", "queue", (F.col("base") + F.col("inside")).alias("base"))
    bases = sent_if_small(written(bases, "packing-bases"), SENT_PLACES)
    rows = tokens.join(bases, ["source", "part"]).select("doc_id", "source", "ids", "n", "queue", (F.col("base") + F.col("before")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if max(bpe.load(path).size, end_id + 1) <= 1 << 16 else "<u4"
        for part in slices(batches, "ids", SLICE_IDS):
            queue = part.column("queue").to_numpy(zero_copy_only=False)
            at, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
            ids = part.column("ids").to_pylist()
            for q in np.unique(queue):
                own = np.flatnonzero(queue == q)
                yield from cut(part, int(q), own[np.argsort(at[own])], at, n, ids, kind)

    def cut(part, q, own, at, n, ids, kind) -> Iterator[pa.RecordBatch]:
        """Pieces of the rows own, all of queue q and in its order; runs of adjacent documents share their windows."""
        gaps = np.flatnonzero(at[own][1:] != (at[own] + n[own])[:-1]) + 1
        for run_ in np.split(own, gaps):
            a, b = at[run_], at[run_] + n[run_]
            low, high = window_at(int(a[0]), q, plan, length), window_at(int(b[-1]) - 1, q, plan, length) + 1
            ahead, ends = sent(np.arange(low, high + 1), q, plan, length)
            ahead = np.diff(ahead)  # tokens of earlier queues in each window
            first = np.searchsorted(ends, a, side="right") - 1
            count = np.searchsorted(ends, b, side="left") - first
            doc = np.repeat(np.arange(len(run_)), count)
            window = first[doc] + ranges(count)
            start = np.maximum(a[doc], ends[window])
            size = np.minimum(b[doc], ends[window + 1]) - start
            keep = size > 0
            doc, window, start, size = doc[keep], window[keep], start[keep], size[keep]
            inside = start - a[doc]
            pieces = [np.frombuffer(ids[run_[d]], kind)[s : s + m].astype("<u4") for d, s, m in zip(doc.tolist(), inside.tolist(), size.tolist(), strict=True)]
            rows = pa.array(run_[doc])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(rows), pa.array(inside, pa.int64()), pa.array(size, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                    pa.array(n[run_[doc]], pa.int64()), pa.array(window + low, pa.int64()), pa.array(ahead[window] + start - ends[window], pa.int64()), part.column("source").take(rows),
                    *([pa.array([x.astype(np.int32) for x in pieces], pa.list_(pa.int32()))] if with_ids else []),
                ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *(["ids"] if with_ids else [])],
            )

    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string{more}")


def packed_digests(docs: DataFrame, **options) -> DataFrame:
    """The rows of packed() without their ids."""
    return packed(docs, with_ids=False, **options)


def _queues(sums: DataFrame, length: int, targets: dict[str, float]) -> tuple[list[str], list[int], list[int]]:
    """Names of the sources with a queue of their own (queue 1 and on), and all queues' totals and weights (queue 0: all other sources)."""
    if sum(targets.values()) > 1 + 1e-9 or any(t * length < LEAST_TOKENS for t in targets.values()):
        raise ValueError(f"targets must be {LEAST_TOKENS} tokens of a window or more each, and 1 in all at most")
    grid = 10**9
    goal = {k: round(v * grid) for k, v in targets.items()}
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    named = by_source.filter(F.col("source").isin(list(goal))) if goal else by_source.limit(0)
    total = sums.agg(F.sum("n")).first()[0] or 0
    own = {r["source"]: r["n"] for r in named.orderBy("source").collect()}  # a row for each target at most
    free, left = total - sum(own.values()), max(0, grid - sum(goal.values()))
    # at most length / LEAST_TOKENS sources have so many tokens of each window
    large = (F.col("n").cast("decimal(38,0)") * length * left >= F.lit(free).cast("decimal(38,0)") * (LEAST_TOKENS * grid)) if left else F.col("n") * length >= free * LEAST_TOKENS
    own |= {r["source"]: r["n"] for r in by_source.filter(large & ~F.col("source").isin(list(goal))).orderBy("source").collect()}
    names = sorted(own)
    rest = total - sum(own.values())
    weights = [goal[s] * max(free, 1) if s in goal else left * own[s] for s in names]
    return names, [rest, *[own[s] for s in names]], [left * rest, *weights]
