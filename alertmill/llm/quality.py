"""Quality classifier (10): an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Documents are dealt into shards, as compressed blocks. Each shard gives the distinct n-grams of its documents, with the counts of
its trusted ones; those are summed over shards, turned into probabilities by joins on n-gram and context,
and joined back to each shard's n-grams. So a shard gets what it needs of the model and no more, the model
is never in one place, and counts cover every trusted document.

Texts fall into two halves by hash (copies into the same). Each half is scored by the model of the other, so
no document is scored by a model that has seen it, and thresholds hold for unseen documents too.

A document has three scores: the mean over all of its characters, which junk of any length raises, its
worst window, which a single strange word raises however much normal prose stands around it, and its burst,
which an n-gram raises that comes far more often than trusted text makes likely, however usual each place is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.llm.common import SLICE_CHARS, partitions, sent_if_small, slices, written
from alertmill.llm.textops import code_points

#: Characters of an n-gram: 16 bits each, so one number holds it and its context and its rest are shifts.
ORDER = 4
#: Bytes of text of a shard, on average.
SHARD_BYTES = 24_000_000
#: The quantile of a language's trusted scores beyond which a document is rejected, and by what factor.
QUANTILE, FACTOR = 0.995, 1.05
#: A score is the perplexity less what chance adds to few characters: divided by exp(CHANCE / sqrt(n_chars)).
CHANCE = 2.0
#: Characters of a window, and the quantile of a language's trusted worst windows beyond which a document is rejected.
WINDOW, WINDOW_QUANTILE = 5, 0.99
#: The quantile of a language's trusted bursts beyond which a document is rejected, and by what factor: 1.1 and, as a high quantile of n rows is uncertain, 3 / sqrt(n).
BURST_QUANTILE, BURST_FACTOR, BURST_CHANCE = 0.995, 1.1, 3.0

#: Bytes of text that a task gathers before it cuts them into one block for each shard.
BLOCK_BYTES = 16_000_000
#: Level of the blocks' compression: they are most of what is moved.
BLOCK_LEVEL = 6
#: N-grams (with repeats between slices) that a shard holds before it adds them up.
HELD_GRAMS = 100_000
#: Rejected rows up to which their keys are sent to all tasks; more are joined.
SENT_ROWS = 1_000_000
#: Languages up to which the table of their discounts (four numbers each) is sent to all tasks.
FEW_LANGUAGES = 1000

_MASK = {1: 0xFFFF, 2: 0xFFFFFFFF, 3: 0xFFFFFFFFFFFF}


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character (before a text: zeros), and where each text starts (one more entry).

    Characters beyond 16 bits are folded into them, which may give two of them one number.
    """
    points, offsets = code_points(texts)
    code = (points ^ (points >> 16)).astype(np.uint64) & np.uint64(0xFFFF)
    code[code == 0] = 0xFFFF  # zero stands for no character
    out = code.copy()
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        moved = np.zeros_like(code)
        moved[back:] = code[: len(code) - back]
        moved[place < back] = 0
        out |= moved << np.uint64(16 * back)
    return out.view(np.int64), offsets


def _other(key: str) -> str:
    return ("1" if key[0] == "0" else "0") + key[1:]


def _per_language(table: pa.Table) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Rows of a shard by half and language, in slices: that key, row numbers, texts."""
    keys = table.column("key").combine_chunks().dictionary_encode()
    code, size = keys.indices.to_numpy(), pc.binary_length(table.column("text")).to_numpy()
    for i, name in enumerate(keys.dictionary.to_pylist()):
        own = np.flatnonzero(code == i)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[own]) // SLICE_CHARS)) + 1
        for rows in np.split(own, cuts):
            yield name, rows, table.column("text").take(pa.array(rows)).to_pylist()


def _blocks(base: DataFrame) -> DataFrame:
    """shard and block: the rows of base (doc_id, row, lang, key, text, shard) that a task has for a shard, as one compressed Arrow stream."""
    names = ["doc_id", "row", "lang", "key", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", BLOCK_LEVEL))
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            shard = rows.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            out = []
            for own in np.split(order, cuts):
                sink = pa.BufferOutputStream()
                part = rows.select(names).take(pa.array(own)).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_table(part)
                out.append((int(shard[own[0]]), sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["shard", "block"])

        for part in slices(batches, limit=BLOCK_BYTES):
            held.append(part)
            size += part.get_total_buffer_size()
            if size >= BLOCK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return base.select(*names, "shard").mapInArrow(run, "shard long, block binary")


def _opened(blocks: pa.Table) -> pa.Table | None:
    found = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks.column("block")]
    return pa.concat_tables(found) if found else None


_GRAMS = T.StructType([T.StructField("shard", T.LongType(), False), T.StructField("lang", T.StringType(), False), T.StructField("gram", T.LongType(), False), T.StructField("c", T.LongType(), False)])
_NO_GRAMS = pa.table({"shard": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "gram": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})


def _shard_grams(key, blocks: pa.Table, trusted: pa.Table) -> pa.Table:
    docs = _opened(blocks)
    if docs is None:
        return _NO_GRAMS
    ids = set(trusted.column("doc_id").to_pylist())
    good = np.array([i is not None and i in ids for i in docs.column("doc_id").to_pylist()], bool)
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(key: str, gram: np.ndarray, c: np.ndarray) -> None:
        held = found.setdefault(key, [])
        held.append((gram, c))
        if len(held) > 1 and sum(len(g) for g, _ in held[1:]) > max(HELD_GRAMS, len(held[0][0])):
            found[key] = [_summed(held)]

    for lang, rows, texts in _per_language(docs):
        gram, offsets = grams(texts)
        codes, names = pd.factorize(gram)
        weight = np.repeat(good[rows], np.diff(offsets))
        counts = np.bincount(codes[weight], minlength=len(names))
        # scored by its own key's model, counted in the other half's
        add(lang, names, np.zeros(len(names), np.int64))
        add(_other(lang), names[counts > 0], counts[counts > 0])
    parts = []
    for lang, held in found.items():
        gram, c = _summed(held)
        parts.append(pa.table({"shard": np.full(len(gram), key[0].as_py(), np.int64), "lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "c": c}))
    return pa.concat_tables(parts) if parts else _NO_GRAMS


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their summed counts."""
    gram, c = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    codes, names = pd.factorize(gram)
    return names, np.bincount(codes, c, len(names)).astype(np.int64)


def worst_windows(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest -log p of WINDOW adjacent characters of each text (of the whole text if it is shorter; empty: 0), from running sums of log p."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes))
    end = np.arange(1, offsets[-1] + 1)
    # a window cut short by the start of its text is never above the first whole one
    window = sums[np.maximum(end - WINDOW, np.repeat(offsets[:-1], sizes))] - sums[end]
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.maximum.reduceat(window, offsets[:-1][some])
    return out


def bursts(codes: np.ndarray, offsets: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Of each text the largest log likelihood ratio of an n-gram's own count k, above one and above the expected m, to m: k log(k / m) - k + m (none: 0).

    codes: the n-gram at each character, offsets: where texts start, rate: each n-gram's share of trusted text.
    """
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes))
    place, k = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(rate) + codes, return_counts=True)
    if len(place):
        text, gram = np.divmod(place, len(rate))
        m = sizes[text] * rate[gram]
        ratio = np.where((k > 1) & (k > m), k * np.log(k / m) - k + m, 0.0)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = np.maximum.reduceat(ratio, first)
    return out


def _shard_scores(key, blocks: pa.Table, model: pa.Table) -> pa.Table:
    """doc_id, row, lang, n_chars, the sum of log probabilities, the worst window and the burst of each document. A shard of the model always has documents."""
    docs = _opened(blocks)
    total, worst, burst, size = np.zeros(docs.num_rows), np.zeros(docs.num_rows), np.zeros(docs.num_rows), np.zeros(docs.num_rows, np.int64)
    langs = model.column("lang").to_numpy(zero_copy_only=False)
    gram, logp, rate = (model.column(c).to_numpy() for c in ("gram", "logp", "rate"))
    by_lang = {}
    for lang in set(langs):
        own = np.flatnonzero(langs == lang)
        order = own[np.argsort(gram[own])]
        by_lang[lang] = gram[order], logp[order], rate[order]
    for lang, rows, texts in _per_language(docs):
        code, offsets = grams(texts)
        codes, names = pd.factorize(code)
        if len(names):
            known, values, rates = by_lang[lang]
            at = np.searchsorted(known, names)
            sums = np.concatenate([[0.0], np.cumsum(values[at][codes])])
            total[rows] = sums[offsets[1:]] - sums[offsets[:-1]]
            worst[rows] = worst_windows(sums, offsets)
            burst[rows] = bursts(codes, offsets, rates[at].astype(np.float64))
        size[rows] = np.diff(offsets)
    return pa.table([docs.column("doc_id"), docs.column("row"), docs.column("lang"), pa.array(size), pa.array(total), pa.array(worst), pa.array(burst)], names=["doc_id", "row", "lang", "n_chars", "log_sum", "worst", "burst"])


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, total (the sum of c) and the three discounts d1, d2, d3 from the numbers of n-grams seen once to four times; 0.5, 1 and 1.5 where those are missing."""
    n = counts.groupBy("lang").agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = [F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))))).otherwise(F.lit(0.5 * i)).alias(f"d{i}") for i in (1, 2, 3)]
    return n.select("lang", "total", *d)


def probabilities(counts: DataFrame, few_languages: bool = False) -> DataFrame:
    """lang, gram, p and rate of each n-gram of counts (lang, gram, c; c may be 0); lang may name a half too. rate: c + 1 by the sum of c.

    The longest n-grams have their counts, shorter ones the number of different characters before them.
    Each order takes its discount, by count 1, 2 or more, and hands it to the next shorter one; below single
    characters stands an even share of 1 / 65536.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_MASK[k])).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c"))
    lower = None
    for k in range(1, ORDER + 1):
        context = F.shiftrightunsigned(F.col("gram"), 16)
        around = Window.partitionBy("lang", "context")
        discounts = _discounts(tables[k])
        now = tables[k].withColumn("context", context).join(F.broadcast(discounts) if few_languages else discounts, "lang")
        now = now.withColumns({"sum": F.sum("c").over(around), "left": F.sum(F.expr("case when c = 0 then 0.0D when c = 1 then d1 when c = 2 then d2 else d3 end")).over(around)})
        own = F.expr("case when c = 0 then 0.0D when c = 1 then c - d1 when c = 2 then c - d2 else c - d3 end")
        if lower is None:
            now = now.withColumn("q", F.lit(1 / 65536))
        else:
            now = now.withColumn("gram_below", F.col("gram").bitwiseAND(F.lit(_MASK[k - 1]))).join(lower, ["lang", "gram_below"])
        now = now.select("lang", "gram", F.when(F.col("sum") > 0, (own + F.col("left") * F.col("q")) / F.col("sum")).otherwise(F.col("q")).alias("p"), ((F.col("c") + 1) / F.greatest("total", F.lit(1))).alias("rate"))
        lower = now.select("lang", F.col("gram").alias("gram_below"), F.col("p").alias("q"))
    return now


def _row(*columns: str) -> Column:
    return F.xxhash64(F.lit(17), *columns)


def half(text):
    """0 or 1, by the text alone."""
    return F.pmod(F.xxhash64(F.lit(3), text), F.lit(2))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, row, lang, n_chars, perplexity, worst (window) and burst (all null for empty texts) of each row of docs; trusted: a table of doc_id."""
    spark = docs.sparkSession
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"))
    size = base.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few, n = size[0] <= FEW_LANGUAGES, max(1, -(-size[1] // SHARD_BYTES))
    base = base.withColumn("row", _row("doc_id", "text", "lang")).withColumn("key", F.concat(half(F.col("text")).cast("string"), "lang")).withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("row").cast("string"))), F.lit(n)))
    ids = trusted.filter("doc_id is not null").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n)).alias("shard"))
    dealt = _blocks(base).groupBy("shard")
    # one exchange, read for the model and for the shards: both take all of its columns, and under names of their own, so
    # that Spark sees one plan in both places
    found = dealt.cogroup(ids.groupBy("shard")).applyInArrow(_shard_grams, _GRAMS).repartition(partitions(spark), "lang", "gram")
    model = probabilities(found.groupBy("lang", "gram").agg(F.sum(F.when(F.col("shard") >= 0, F.col("c"))).alias("c")), few)
    own = found.select("shard", F.col("lang").alias("own_lang"), F.col("gram").alias("own_gram"), F.col("c").alias("own_c"))
    joined = own.join(model, (F.col("own_lang") == F.col("lang")) & (F.col("own_gram") == F.col("gram")))
    needed = joined.select("shard", "lang", "gram", F.when(F.col("own_c") >= 0, F.log("p")).cast("float").alias("logp"), F.col("rate").cast("float").alias("rate"))
    kind = base.schema["doc_id"].dataType.simpleString()
    scored = dealt.cogroup(needed.groupBy("shard")).applyInArrow(_shard_scores, f"doc_id {kind}, row long, lang string, n_chars long, log_sum double, worst double, burst double")
    some = F.col("n_chars") > 0
    return scored.select("doc_id", "row", "lang", "n_chars", F.when(some, F.exp(-F.col("log_sum") / F.col("n_chars"))).alias("perplexity"), F.when(some, F.col("worst")).alias("worst"), F.when(some, F.col("burst")).alias("burst"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled as good and not toxic; conflicting labels make a document not trusted."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")).filter("good = 1").select("doc_id")


def _limits(values: DataFrame, quantile: float) -> DataFrame:
    """lang, the least value of its rows (lang, value) that the given share of them does not exceed, and n, the number of its rows."""
    by_lang = Window.partitionBy("lang")
    bins = values.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumns({"below": F.sum("n").over(by_lang.orderBy("value")), "all": F.sum("n").over(by_lang)})
    return bins.filter(F.col("below") >= quantile * F.col("all")).groupBy("lang").agg(F.min("value").alias("value"), F.max("all").alias("n"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, factor: float = FACTOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window_quantile: float = WINDOW_QUANTILE, burst_quantile: float = BURST_QUANTILE) -> DataFrame:
    """doc_id, row, lang, n_chars, perplexity, worst, burst, score, threshold, worst_threshold, burst_threshold and kept of each row of docs.

    A document is rejected if its score is above its language's threshold, factor times the given quantile
    of the language's trusted documents' scores (to 1 / 10000), or its worst window above the
    window_quantile or its burst above BURST_FACTOR + BURST_CHANCE / sqrt(n) times the burst_quantile of theirs (n; both to 1 / 1000). A value at its threshold is not above it. A language without trusted documents has no thresholds and loses nothing; nor
    does an empty text. Null languages are one language.
    """
    good = trusted_ids(labels)
    scored = perplexities(docs, good, id_col, text_col, lang_col).withColumns({"score": F.col("perplexity") * F.exp(-CHANCE / F.sqrt("n_chars")), "worst": F.round("worst", 3), "burst": F.round("burst", 3)})
    scored = written(scored, "quality-scores")
    of_trusted = scored.filter("score is not null").join(good, "doc_id", "left_semi")
    # counts on grids (1 / 10000 in the logarithm, 1 / 1000): bounded for each language, and the same in any order of summing
    limits = _limits(of_trusted.select("lang", F.round(F.log("score") * 10_000).alias("value")), quantile).select("lang", (F.exp(F.col("value") / 10_000) * factor).alias("threshold"))
    worst_limits = _limits(of_trusted.select("lang", F.col("worst").alias("value")), window_quantile).select("lang", F.col("value").alias("worst_threshold"))
    burst_limits = _limits(of_trusted.select("lang", F.col("burst").alias("value")), burst_quantile).select("lang", (F.col("value") * (BURST_FACTOR + BURST_CHANCE / F.sqrt("n"))).alias("burst_threshold"))
    kept = (F.col("score") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold")) & (F.col("burst") <= F.col("burst_threshold"))
    return scored.join(limits, "lang", "left").join(worst_limits, "lang", "left").join(burst_limits, "lang", "left").withColumn("kept", F.coalesce(kept, F.lit(True)))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, whatever their names."""
    bad = written(judged(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **options).filter("not kept").select("doc_id", "row"), "quality-rejected")
    empty = F.lit("")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("all"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), empty).alias("text"), F.coalesce(docs[lang_col].cast("string"), empty).alias("lang"))
    keyed = keyed.select("all", "doc_id", _row("doc_id", "text", "lang").alias("row"))
    bad = sent_if_small(bad, SENT_ROWS)
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed["row"] == bad["row"]), "left_anti").select("all.*")
