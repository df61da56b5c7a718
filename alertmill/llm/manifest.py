"""Merkle manifest of a data set (13): built-in DataFrame functions alone.

Nodes of a tree lie in aligned blocks of FANOUT ** LEVELS. A block keeps each of its levels as one string of
hexadecimal digests; parents are hashes of substrings of fixed width, and a node's siblings are the two
substrings beside it in its run. What is left of the blocks is the next round's nodes, so a tree of any size takes
a few rounds, each FANOUT ** LEVELS times smaller than the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import partitions, written

FANOUT = 3
#: Levels inside a block: 243 nodes, 15,552 digits.
LEVELS = 5
BLOCK = FANOUT**LEVELS
#: Digits of a digest.
WIDTH = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source), doc_id, node (the leaf), tampered (the leaf without line feeds in its text, where 2 divides the CRC-32 of the decimal doc_id) and tie, which tells repeated rows apart."""
    own = {c: docs[c] for c in FIELDS}
    hit = F.coalesce(F.crc32(own["doc_id"].cast("string")) % 2 == 0, F.lit(False)) & F.contains(own["text"].cast("string"), F.lit("\n"))
    other = F.when(hit, leaf(own | {"text": F.replace(own["text"].cast("string"), F.lit("\n"))}))
    return docs.select(own["source"].cast("string").alias("tree"), own["doc_id"].alias("doc_id"), leaf(own).alias("node"), other.alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes, a written table, with pos: the place of each in its tree, from 0.

    Nodes are sorted in sampled ranges of tree and order; a range's first place follows from the sizes of the
    tree's ranges before it, so a tree with a third of all rows is many tasks' work.
    """
    spread = nodes.repartitionByRange(partitions(nodes.sparkSession), "tree", *order).withColumn("part", F.spark_partition_id())
    spread = written(spread, "merkle-ranges")
    sizes = spread.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select(F.col("tree").alias("of_tree"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = spread.withColumn("inside", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)))
    joined = inside.join(sizes, F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("part") == F.col("of_part")))
    return joined.withColumn("pos", F.col("base") + F.col("inside") - 1).drop("of_tree", "of_part", "base", "inside", "part")


def _parents(level: Column) -> Column:
    """The level above one: digests are ASCII, so the string is cut as bytes, at once wherever."""
    run = FANOUT * WIDTH
    n = F.ceil(F.length(level) / run).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """tree, block, members (pos, node and the columns of carry, in order), levels and top of placed nodes.

    levels are strings, as bytes; the last is the block's root, top. Where a tree is one block, its levels end with its root; otherwise
    every block has all LEVELS levels. A block has at most BLOCK nodes.
    """
    rows = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", *carry))).alias("members"))
    alone = (F.col("block") == 0) & (F.size("members") < BLOCK)
    done = lambda levels: alone & (F.length(F.element_at(levels, -1)) == WIDTH)
    first = F.array(F.array_join(F.col("members")["node"], "").cast("binary"))
    grow = lambda levels, _: F.when(done(levels), levels).otherwise(F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))
    rows = rows.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), first, grow))
    return rows.withColumn("top", F.element_at("levels", -1).cast("string"))


def rounds(nodes: DataFrame, carry: list[str], name: str) -> list[DataFrame]:
    """The block tables of placed nodes, the leaves' first; in the last each tree is one block. A tree that ends earlier goes on as its root alone."""
    found = [written(blocks(nodes, carry), f"merkle-{name}")]
    while not found[-1].filter("block > 0").isEmpty():
        found.append(written(blocks(found[-1].select("tree", F.col("block").alias("pos"), F.col("top").alias("node")), []), f"merkle-{name}"))
    return found


def path(levels: Column, at: Column) -> Column:
    """For each level below the last: the digests left and right of node at's ancestor in its run."""
    def beside(k: Column) -> Column:
        i = F.floor(at / F.pow(F.lit(FANOUT), k - 1)).cast("int")
        place = i % FANOUT
        text = F.element_at(levels, k)
        left = F.substring(text, (i - place) * WIDTH + 1, place * WIDTH)
        right = F.substring(text, (i + 1) * WIDTH + 1, (FANOUT - 1 - place) * WIDTH)
        return F.struct(left.cast("string").alias("l"), right.cast("string").alias("r"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(1), F.size(levels) - 1), beside)).otherwise(F.array().cast(_PATH))


def folded(node: Column, siblings: Column) -> Column:
    """The root that a node and the siblings on its way give."""
    return F.aggregate(siblings, node, lambda x, s: F.sha2(F.concat(s["l"], x, s["r"]), 256))


def members_with_paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The members of the first of rounds() with tree and path, all siblings up to the root of above (of_tree, up, a path, and root)."""
    up = above.withColumn("of_block", F.lit(0).cast("long"))
    for table in reversed(tables):
        joined = table.join(up, F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("block") == F.col("of_block")))
        each = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(path(F.col("levels"), i), F.col("up")).alias("path")))
        out = joined.select("tree", "root", F.inline(each))
        up = out.select(F.col("tree").alias("of_tree"), F.col("m")["pos"].alias("of_block"), F.col("path").alias("up"), "root")
    return out.select("tree", "root", "m.*", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs has the columns of FIELDS; others are left alone. Each value of source, null too, is a tree whose
    leaves ascend by doc_id (nulls first; repeated ids by digest); the trees' roots, by source, make the tree of root. An
    empty table has no row. Texts are hashed where they are read; rows of digests alone are moved.
    """
    leaf_rows = written(leaves(docs), "merkle-leaves")
    sources = rounds(placed(leaf_rows, ["doc_id", "node", "tie"]), ["doc_id", "tampered"], "sources")
    roots = sources[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("top").alias("node"))
    whole = rounds(placed(written(roots, "merkle-subroots"), ["source"]), ["source"], "whole")
    top = whole[-1].select(F.col("tree").alias("of_tree"), F.array().cast(_PATH).alias("up"), F.col("top").alias("root"))
    above = members_with_paths(whole, top).select(F.col("source").alias("of_tree"), F.struct("path", F.col("node").alias("subroot")).alias("of"), "root")
    above = above.select("of_tree", F.col("of.path").alias("up"), F.struct("root", F.col("of.subroot").alias("subroot")).alias("root"))
    found = members_with_paths(sources, above)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    found = found.select("doc_id", F.col("node").alias("leaf"), "root.subroot", "root.root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
