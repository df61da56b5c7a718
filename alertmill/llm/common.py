"""What the text operators share: input columns, shared-folder tables, batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.hot import join_groups, sent_if_small  # noqa: F401
from alertmill.sources.shared import written  # noqa: F401

#: Text that is worked on at once inside a Python task, in characters; bounds a worker's memory.
SLICE_CHARS = 400_000
#: The white space of all word, line and text contracts.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and further columns, without any others: extra columns cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def row_key() -> Column:
    """Rows that agree in doc_id and text are one document; rows that agree in doc_id alone are not."""
    return F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str | tuple[str, ...] = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where their texts pass limit bytes; one longer text is a slice of its own."""
    names = (text,) if isinstance(text, str) else text
    for batch in batches:
        if not batch.num_rows:
            continue
        start = held = 0
        sizes = [sum(x) for x in zip(*[pc.binary_length(batch.column(n)).fill_null(0).to_pylist() for n in names], strict=True)]
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
