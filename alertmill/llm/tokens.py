"""Token counts by overlap resynchronisation (1), and BPE encoding and decoding by forced boundaries (6).

Both are one pass without a shuffle: rows stay where they were read, and a task holds one slice of texts.
Null and empty texts have 0 tokens; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertmill.llm import bpe
from alertmill.llm.common import slices, texts

#: Characters of a chunk and of its overlap with the next; longer texts are never encoded whole.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256


def token_counts(docs: DataFrame, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks, n_widened of each row, by overlapping chunks with offsets.

    Long texts are encoded in overlapping chunks, spliced at proven stable common boundaries; an overlap
    without one is widened. A text of one endless run ends up encoded whole.
    """
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for part in slices(batches):
            rows = part.column("text").to_pylist()
            found = [coder.count(t, chunk_chars, overlap_chars) for t in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in rows], pa.int64()), *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    narrow = texts(docs, id_col=id_col, text_col=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_chunks bigint, n_widened bigint")


def encoded(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row: fragments between forced boundaries, encoded apart and concatenated."""
    return _coded(docs, vocabulary, id_col, text_col, "ids array<int>", lambda coder, t, ids: (ids.astype(np.int32),))


def decoded(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; special ids give their strings, broken UTF-8 the replacement character, null an empty text."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([coder.decode(np.array(x or [], np.uint32)) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    narrow = tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and keep digests of both alone: doc_id, n_tokens, ids_sha256, decoded_sha256, n_fragments."""

    def digests(coder: bpe.ByteBpe, text: str, ids: np.ndarray) -> tuple:
        back = coder.decode(ids).encode("utf-8")
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), len(coder.fragments(text))

    return _coded(docs, vocabulary, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_fragments bigint", digests)


def _coded(docs, vocabulary, id_col, text_col, schema, each) -> DataFrame:
    path = vocabulary or bpe.default_vocabulary()
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for part in slices(batches):
            rows = [each(coder, t, coder.encode_fragments(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)]], names=["doc_id", *[n for n, _ in fields]])

    narrow = texts(docs, id_col=id_col, text_col=text_col)
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {schema}")
