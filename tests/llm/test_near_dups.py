import collections
import itertools
import random

import numpy as np
import pytest

from alertmill.llm import near_dups

SF = "/root/testdata/sf0.001"


def bag(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = min(5, len(words))
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else collections.Counter()


def similarity(a, b):
    if not a and not b:
        return 1.0
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def brute_classes(rows):
    """Components of all pairs of similarity 0.8 or more, by smallest id."""
    bags = {i: bag(t) for i, t in rows}
    at = collections.defaultdict(set)
    for i, b in bags.items():
        for k in b or [None]:
            at[k].add(i)
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in {p for g in at.values() for p in itertools.combinations(sorted(g), 2)}:
        if similarity(bags[x], bags[y]) >= 0.8:
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {i: root(i) for i in bags}


@pytest.mark.parametrize(("rows", "block"), [("given", 512), ("made", 512), ("made", 3)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    if rows == "given":
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    else:
        rng = random.Random(3)
        word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(50))
        data, i = [], 0
        for _ in range(12):
            base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
            for _ in range(rng.choice([1, 2, 9])):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 2, 3])):
                    copy[rng.randrange(len(copy))] = word()
                data.append((i, rng.choice([" ", "\n"]).join(copy), "x"))
                i += 1
        # a chain of drifting copies, repeated rows, empties and a null
        base = [word() for _ in range(120)]
        for _ in range(15):
            base[rng.randrange(120)] = word()
            data.append((i, " ".join(base), "x"))
            i += 1
        data += [(i, "", "x"), (i + 1, None, "x"), (i + 2, "  \n", "x"), (i + 3, "one", "x")]
        docs = spark.createDataFrame(data, "doc_id long, text string, node string")
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in near_dups.without_near_duplicates(docs).collect()}
    assert kept == set(want.values())


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    other = base[:300] + [str(rng.randrange(10**6)) for _ in range(100)]
    texts = [" ".join(base), " ".join(other), "one two", ""]
    text, cell, *_ = near_dups.cells(texts)
    signs = near_dups.dart_signatures(text, cell, 4, 4096)
    assert abs(np.mean(signs[0] == signs[1]) - similarity(bag(texts[0]), bag(texts[1]))) < 0.04
    assert (signs[3] == near_dups._NONE).all() and (signs[2] != near_dups._NONE).all()
    again = near_dups.dart_signatures(*near_dups.cells([texts[1]])[:2], 1, 4096)
    assert (again[0] == signs[1]).all()  # whatever stands beside it


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["class_id"], r["class_size"], r["kept"]) for r in near_dups.near_duplicates(rows).collect() if r["class_id"] is not None)
    assert got == [(False, 7, 3, True), (False, 7, 3, True), (True, 7, 3, False)]


def test_chunks_let_all_classes_meet_and_no_class_meet_itself(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    data = [(1, i, 100) for i in range(40)] + [(1, 50 + i, 200) for i in range(9)] + [(1, 70 + i, 300 + i) for i in range(6)] + [(2, 90, 300), (2, 91, 301)]
    placed, pairs = near_dups.chunk_pairs(spark.createDataFrame(data, "bucket long, node long, component long"))
    met, blocks = set(), collections.defaultdict(list)
    for r in placed.join(pairs, ["bucket", "chunk"]).collect():
        blocks[r["block"]].append((r["bucket"], r["node"], r["component"]))
    for own in blocks.values():
        assert len({b for b, *_ in own}) == 1
        met |= {(x[0], *sorted((x[1], y[1]))) for x, y in itertools.combinations(own, 2)}
    want = {(x[0], *sorted((x[1], y[1]))) for x, y in itertools.combinations(data, 2) if x[0] == y[0] and x[2] != y[2]}
    assert want <= met
    # the large class is sent to each chunk of others once, not to its own chunks
    assert sum(len(own) for own in blocks.values()) < 57 * 8


def test_different_words_on_one_node_stay_apart(spark):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, 11), (3, 6, 12)], "doc_id long, node long, check long")
    got = near_dups.told_apart(rows, spark.createDataFrame([(5,)], "node long")).collect()
    assert len({r["node"] for r in got}) == 3 and near_dups.told_apart(rows, None) is rows


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "x", 9, 10)], "doc_id long, text string, _near_key int, key int")
    assert sorted(map(tuple, near_dups.without_near_duplicates(docs).collect())) == [(1, "a b c", 5, 6), (3, "x", 9, 10)]
