"""Exact documents (3) and repeated lines (4): built-in DataFrame functions alone.

Both sort by content in sampled ranges. A group of equals too large for one range (one text, or one line,
may be in a third of all rows) is salted first: the P largest groups are found by a pre-aggregated count,
and those above the P-th one's size are cut into parts of that size, whose results are merged afterwards.
Every other group has less than one P-th of all rows, so no task is much larger than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import SPACE_CLASS, partitions, row_key, texts, written

#: Groups of at most this many rows are never salted.
SMALL_GROUP = 1000
#: Characters of a text that order it before its digest does.
PREFIX = 32


def salted(rows: DataFrame, keys: list[str], spread: str) -> tuple[DataFrame, list[str]]:
    """rows with n_salts (null: not salted) and, if any group is salted, salt; the list ["salt"], or an empty one.

    The list of large groups has at most one entry for each shuffle partition, whatever the input.
    """
    n = partitions(rows.sparkSession)
    top = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), *keys).limit(n).collect()
    part = max(SMALL_GROUP, top[-1]["size"] if len(top) == n else 0)
    hot = [(*[r[k] for k in keys], -(-r["size"] // part)) for r in top if r["size"] > part]
    if not hot:
        return rows.withColumn("n_salts", F.lit(None).cast("long")), []
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n_salts long"
    large = F.broadcast(rows.sparkSession.createDataFrame(hot, schema))
    joined = rows.join(large, keys, "left")
    return joined.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.lit(5), spread), F.col("n_salts")), F.lit(0))), ["salt"]


def normalised(text):
    """Each run of white space as one space; single spaces stay untouched, which saves most replacements."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE_CLASS}]*|\x20[{SPACE_CLASS}]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and with carry: row, its columns).

    Content sort: ranges of normalised texts from sampled splitters, an external sort inside each, and
    whole neighbours compared by the window over the sorted run. Texts are ordered by their first PREFIX
    characters, then by digest, then in full, so splitters stay small however long the texts are. The smallest doc_id stays; null ids are the
    largest, null text is empty. Of repeated rows (one id, one text) one stays. Nothing is dropped here.
    """
    base = texts(docs, id_col=id_col, text_col=text_col)
    if carry:
        base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    base = base.withColumn("text", normalised(F.col("text"))).withColumn("text_sha256", F.sha2("text", 256))
    rows, hot = salted(base.withColumn("prefix", F.substring("text", 1, PREFIX)), ["text_sha256"], "doc_id")
    order = ["prefix", "text_sha256", *hot]
    run = Window.partitionBy(*order, "text").orderBy(F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = ["row"] if carry else []
    runs = (
        rows.repartitionByRange(partitions(docs.sparkSession), *order)
        .select("doc_id", "text_sha256", "n_salts", *more, F.row_number().over(run).alias("place"), F.min("doc_id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"))
    )
    if hot:
        runs = written(runs, "content-sort")
        parts = runs.filter("n_salts is not null and place = 1").groupBy("text_sha256").agg(F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        # as many rows as there are salted groups: at most one for each shuffle partition
        runs = runs.join(F.broadcast(parts), "text_sha256", "left")
        runs = runs.withColumn("place", F.when(F.col("n_salts").isNull() | F.col("all_keep").eqNullSafe(F.col("keep_id")), F.col("place"))).withColumns(
            {"keep_id": F.when(F.col("n_salts").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")), "group_size": F.coalesce("all_size", "group_size")}
        )
    return runs.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("place") == 1, F.lit(False)).alias("kept"), "text_sha256", *more)


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return exact_duplicates(docs, id_col, text_col, carry=True).filter("kept").select("row.*")


# --- lines -------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES = r"split(text, '\n', -1)"


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the document, see row_key) and words, a map: bit p % 64 of the 64-bit word p div 64 is 0 where line p goes.

    Bitmaps are compressed: words of ones are left out, and only documents that lose a line have a row. A line goes if
    its key (stripped, A-Z lowered) has min_chars code points, is in min_docs documents, and a larger doc_id
    holds it. Hashes of keys (two of 64 bits) are range-partitioned and sorted by document and position; the
    first document of each run is where it stays. A null doc_id is the smallest; rows that share a doc_id are
    one document.
    """
    base = texts(docs, id_col=id_col, text_col=text_col).withColumn("key", row_key())
    lines = base.select("doc_id", "key", F.posexplode(F.expr(_LINES)).alias("pos", "line"))
    lines = lines.select("doc_id", "key", "pos", F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER).alias("line"))
    lines = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "key", "pos", F.xxhash64(F.lit(1), "line").alias("h"), F.xxhash64(F.lit(2), "line").alias("g"))
    rows, hot = salted(written(lines, "line-hashes"), ["h", "g"], "doc_id")
    run = Window.partitionBy("h", "g", *hot).orderBy(F.desc_nulls_last("doc_id"), "key", "pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = (
        rows.repartitionByRange(partitions(docs.sparkSession), "h", "g", *hot)
        .withColumn("place", F.row_number().over(run))
        .withColumn("new", (F.col("place") == 1) | ~F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id")))
        .withColumns({"n_docs": F.sum(F.col("new").cast("long")).over(whole), "stays": F.max("doc_id").over(whole)})
        .select("doc_id", "key", "pos", "h", "g", "n_salts", "place", "n_docs", "stays")
    )
    if hot:
        firsts = written(firsts, "line-firsts")
        parts = firsts.filter("n_salts is not null and place = 1").groupBy("h", "g").agg(F.sum("n_docs").alias("all_docs"), F.max("stays").alias("all_stays"))
        # as many rows as there are salted groups: at most one for each shuffle partition
        firsts = firsts.join(F.broadcast(parts), ["h", "g"], "left").withColumns({"n_docs": F.coalesce("all_docs", "n_docs"), "stays": F.coalesce("all_stays", "stays")})
    go = firsts.filter((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("stays")))
    words = go.groupBy("doc_id", "key", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    return words.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of each row: its lines where the bitmap has 1, joined by \\n. No line left: an empty text."""
    base = texts(docs, id_col=id_col, text_col=text_col).withColumn("key", row_key())
    maps = line_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), F.expr("transform(sequence(0, array_max(map_keys(words))), w -> coalesce(words[w], -1L))").alias("words"))
    joined = base.join(maps, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").withColumn("lines", F.expr(_LINES))
    kept = F.expr("if(words is null, lines, filter(lines, (x, i) -> i div 64 >= size(words) or (shiftrightunsigned(words[cast(i div 64 as int)], i % 64) & 1L) = 1L))")
    return joined.withColumn("kept", kept).select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
