"""The registered queries of the text operators: each reads whole tables and all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm import audit, dedup, fingerprints, html, manifest, near_dups, packing, quality, substrings, tokens, vectors
from alertmill.llm.common import table

#: Tokens beyond which a text is over a context's limit.
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chunks", "n_widened")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoding_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op6_bpe_codec": op6_bpe_codec,
}

ORACLES: dict[str, str] = {}


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES |= {"op3_exact_dedup": op3_exact_dedup, "op4_line_dedup": op4_line_dedup}

ORACLES["op3_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     k AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

ORACLES["op4_line_dedup"] = """
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM a),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.stays AS goes FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(goes AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


QUERIES |= {"op5_fingerprints": op5_fingerprints, "op2_near_dedup": op2_near_dedup}


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeated_passages(table(spark, sf_dir, "documents"), digest=True).drop("rest")


QUERIES |= {"op7_packing": op7_packing, "op8_substring_dedup": op8_substring_dedup}

ORACLES["op8_substring_dedup"] = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS pos FROM a),
     r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(w[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS place FROM s),
     g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM (SELECT doc_id, pos, unnest(range(0, 20)) AS k FROM r WHERE place > 1)),
     o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM a),
     k AS (SELECT o.doc_id, o.word, o.pos, g.pos IS NOT NULL AS goes FROM o LEFT JOIN g USING (doc_id, pos)),
     e AS (SELECT doc_id, count(*) FILTER (WHERE goes) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT goes) AS t FROM k GROUP BY doc_id)
SELECT a.doc_id, CAST(len(a.w) AS BIGINT) AS n_words, coalesce(e.n, 0) AS n_removed, sha256(coalesce(e.t, '')) AS kept_sha256
FROM a LEFT JOIN e USING (doc_id)
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


QUERIES |= {"op9_html_text": op9_html_text}


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


QUERIES |= {"op10_quality": op10_quality}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES |= {"op11_filter_audit": op11_filter_audit, "op12_vector_dedup": op12_vector_dedup, "op13_merkle_manifest": op13_merkle_manifest}

ORACLES["op11_filter_audit"] = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
     d AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
                  regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
           FROM w LEFT JOIN l USING (doc_id)),
     g AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
     s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
     m AS (SELECT part, o, step, o[step] AS f, n, good, toxic, g.f[o[step]] AS fails, len(list_filter(o[:step - 1], lambda k: g.f[k])) > 0 AS gone,
                  len(list_filter(o, lambda k: g.f[k])) = 1 AS alone FROM g, s),
     r AS (SELECT part, o, step, f, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE NOT gone AND fails) AS removed, sum(n) FILTER (WHERE gone AND fails) AS redundant,
                  sum(n) FILTER (WHERE fails AND alone) AS unique_fails, sum(good) FILTER (WHERE NOT gone AND fails) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND fails) AS toxic_lost
           FROM m GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM r
"""

ORACLES["op12_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
     r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
     c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a
"""

ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE t AS (
       SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, text, concat_ws('', field(CAST(doc_id AS VARCHAR)), field(source), field(lang), field(CAST(n_chars AS VARCHAR))) AS head,
              list_reduce(list_concat([4294967295], list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: (ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1)),
                          lambda c, b: xor(c >> 1, CASE WHEN c & 1 <> b THEN 3988292384 ELSE 0 END)) AS crc FROM documents),
     l AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, sha256(head || field(text)) AS leaf,
                  sha256(head || field(CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END)) AS other FROM t),
     s(tree, lvl, pos, node, n) AS (
       SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM l
       UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM s WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
     u(lvl, pos, node, n) AS (
       SELECT 0, tree, node, count(*) OVER () FROM s WHERE n = 1
       UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
     sr AS (SELECT tree, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM s WHERE n > 1 GROUP BY 1, 2, 3),
     ur AS (SELECT lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM u WHERE n > 1 GROUP BY 1, 2),
     a(doc_id, tree, lvl, pos, now, proof) AS (
       SELECT doc_id, tree, 0, pos, other, '' FROM l
       UNION ALL SELECT doc_id, a.tree, a.lvl + 1, pos // 3, sha256(array_to_string(nodes[:pos % 3], '') || now || array_to_string(nodes[pos % 3 + 2:], '')),
                        proof || array_to_string(nodes[:pos % 3], '') || array_to_string(nodes[pos % 3 + 2:], '')
                 FROM a JOIN sr ON sr.tree = a.tree AND sr.lvl = a.lvl AND sr.run = pos // 3),
     b(doc_id, lvl, pos, now, proof) AS (
       SELECT doc_id, 0, max(tree), arg_max(now, lvl), arg_max(proof, lvl) FROM a GROUP BY doc_id
       UNION ALL SELECT doc_id, b.lvl + 1, pos // 3, sha256(array_to_string(nodes[:pos % 3], '') || now || array_to_string(nodes[pos % 3 + 2:], '')),
                        proof || array_to_string(nodes[:pos % 3], '') || array_to_string(nodes[pos % 3 + 2:], '')
                 FROM b JOIN ur ON ur.lvl = b.lvl AND ur.run = pos // 3),
     f AS (SELECT doc_id, arg_max(now, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM b GROUP BY doc_id)
SELECT doc_id, leaf, s.node AS subroot, u.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = u.node AS verified
FROM l JOIN f USING (doc_id) JOIN s ON s.tree = l.tree AND s.n = 1 JOIN u ON u.n = 1
"""
for _c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "text", "CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END"):
    ORACLES["op13_merkle_manifest"] = ORACLES["op13_merkle_manifest"].replace(f"field({_c})", f"coalesce(octet_length(encode({_c})) || ':' || ({_c}), '-')")
