import collections
import hashlib
import random
import re

import numpy as np
import pytest

from alertmill.llm import dedup, fingerprints, substrings
from alertmill.llm.textops import code_points

WS = "[\x20\x09-\x0d]"


def docs(spark, rng, n=120):
    lines = ["x" * 45 + str(i) for i in range(4)] + ["  " + "X" * 45 + "1\t", "short", "", "é" * 40, "é" * 39]
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 30, 70]))) for _ in range(8)]
    data = []
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            t = "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))
        elif kind == 1:
            t = rng.choice(base)
        elif kind == 2:
            t = rng.choice(base) + "\n" + " ".join(rng.choice("abcdefgh") for _ in range(20)) + rng.choice(["  ", "\t", " "]) + rng.choice(base)
        else:
            t = rng.choice([None, "", " \n ", "a", "same text here", "same  text\there"])
        data.append((i, t, "clash", 0))
    rng.shuffle(data)
    return spark.createDataFrame(data, "doc_id long, text string, h string, place int"), data


def lines_want(data):
    key = lambda s: re.sub(f"^{WS}+|{WS}+$", "", s).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = collections.defaultdict(set)
    for d, t, *_ in data:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(d)
    out = {}
    for d, t, *_ in data:
        own = (t or "").split("\n")
        kept = [s for s in own if not (len(held.get(key(s), ())) >= 5 and max(held[key(s)]) != d)]
        out[d] = len(own), len(own) - len(kept), "\n".join(kept)
    return out


@pytest.mark.parametrize("small", [1000, 3])
def test_exact_and_lines(spark, monkeypatch, small):
    """With groups of more than three rows counting as large, salts are used too."""
    monkeypatch.setattr(dedup, "SMALL_GROUP", small)
    df, data = docs(spark, random.Random(2))
    norm = {d: re.sub(f"{WS}+", " ", t or "") for d, t, *_ in data}
    first, size = {}, collections.Counter(norm.values())
    for d in sorted(norm):
        first.setdefault(norm[d], d)
    want = {d: (first[t], size[t], first[t] == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in dedup.exact_duplicates(df).collect()} == want
    kept = dedup.without_exact_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(first.values())
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in dedup.without_repeated_lines(df).collect()} == lines_want(data)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = dedup.exact_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got if r["keep_id"] == 3) == [("3", False), ("3", True), ("None", False)]
    assert sum(r["kept"] for r in got if r["keep_id"] is None) == 1
    line = "y" * 50
    d = spark.createDataFrame([(i, line) for i in (1, 2, 3, 4, 5, 5)] + [(None, line)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in dedup.without_repeated_lines(d).collect()) == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 0), ("5", 0), ("None", 1)]
    for f in (dedup.exact_duplicates, dedup.without_repeated_lines, substrings.without_repeated_passages, fingerprints.edited_likeness, fingerprints.fingerprints):
        assert f(df.limit(0)).count() == 0


def passages_want(data, words):
    seen, out = set(), {}
    for d, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = re.findall(f"[^\x20\x09-\x0d]+", t or "")
        gone = set()
        for i in range(len(w) - words + 1):
            k = tuple(w[i : i + words])
            if k in seen:
                gone |= set(range(i, i + words))
            seen.add(k)
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


@pytest.mark.parametrize(("words", "shift"), [(20, 0), (8, 0), (4, -50), (8, 1 << 40)])
def test_passages(spark, words, shift):
    _, data = docs(spark, random.Random(words))
    data = [(d + shift, t) for d, t, *_ in data] + [(None, "a b c d " * 12)]
    df = spark.createDataFrame([(d, t, "r", 1) for d, t in data], "doc_id long, text string, rest string, pos int")
    got = substrings.without_repeated_passages(df, words)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == passages_want(data, words)
    assert got.select("rest.rest", "rest.pos").distinct().count() == 1


def test_passages_of_ids_that_are_text(spark):
    """Ids of text go by their text order; a hot passage is dealt to several tasks."""
    _, data = docs(spark, random.Random(4))
    data = [(f"id{d:05d}", t) for d, t, *_ in data] + [(f"z{i:05d}", f"w{i} " + " ".join(f"hot{j}" for j in range(25))) for i in range(1300)]
    got = substrings.without_repeated_passages(spark.createDataFrame(data, "doc_id string, text string"), 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == passages_want(data, 20)


def test_syncmers_are_those_of_the_definition():
    text = "the quick brown fox jumps over the lazy dog and runs away é日"
    found = fingerprints.syncmers([text, "", "short", text[7:]])
    k, s = fingerprints.K, fingerprints.S
    points, _ = code_points([text])
    h = fingerprints.span_hashes(points, *(x for x in ([*range(len(text) - s + 1)], [*range(s, len(text) + 1)]) for x in [__import__("numpy").array(x)]))
    want = [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
    assert found[1][found[0] == 0].tolist() == want
    later = [i - 7 for i in want if i >= 7]
    assert found[1][found[0] == 3].tolist() == later  # wherever the passage stands


def test_fingerprints_and_next(spark):
    df, data = docs(spark, random.Random(9))
    data = [(d, t or "") for d, t, *_ in data]
    order = sorted(data, reverse=True)
    want = {}
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        want[d] = len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()
    got = fingerprints.edited_likeness(df).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = collections.defaultdict(set)
    texts = dict(data)
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in got}
    one = fingerprints.edited_likeness(spark.createDataFrame([(None, "abc" * 20)], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@pytest.mark.parametrize("symbols", [2, 5, 30, 1000])
def test_aligned_anchors_are_the_longest_common_subsequence(symbols):
    rng = np.random.default_rng(symbols)
    for _ in range(40):
        a, b = (rng.integers(0, symbols, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
        b = np.concatenate([a[: len(a) // 3], b, a[len(a) // 2 :]]) if rng.random() < 0.5 else b
        assert fingerprints.aligned(a, b) == common_subsequence(a.tolist(), b.tolist())


def test_long_documents_keep_their_overlaps(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = words(50)
    a, b, c = words(20_000), words(20_000), words(20_000)
    a, b = f"{a} {passage} {words(900)}", f"{words(3000)} {passage} {b}"
    rows = {r["doc_id"]: r for r in fingerprints.edited_likeness(spark.createDataFrame([(3, a), (2, b), (1, c)], "doc_id long, text string")).collect()}
    assert rows[3]["near_next"] > 0.0005 and rows[2]["near_next"] == rows[1]["near_next"] == 0
    assert abs(rows[3]["near_edited"] - 0.5) < 0.01  # two thirds of each of two texts of one length


def plain_anchors(text):
    """The runs of K characters whose smallest run of S stands first or last, in order."""
    k, s = fingerprints.K, fingerprints.S
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = [int(fingerprints.span_hashes(points[i : i + s], np.array([0]), np.array([s]))[0]) for i in range(len(text) - s + 1)]
    at = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return [text[i : i + k] for i in at] or ([text] if text else [])  # a text without anchors is its own


def plain_likeness(a, b):
    a, b = plain_anchors(a), plain_anchors(b)
    if not a or not b:
        return float(len(a) == len(b))
    common = common_subsequence(a, b)
    return common / (len(a) + len(b) - common)


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)", "int"])
def test_likeness_against_plain_python(spark, kind):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(["straße", "the", "of", "näher", "x", "analysis", "report"]) for _ in range(n))
    texts = [words(rng.choice([0, 1, 12, 40, 90])) for _ in range(40)]
    texts += [texts[3], texts[5] + " and more", None, "", "ab" * 60]
    name = {"string": lambda i: f"doc-{i:03d}", "decimal(20,0)": lambda i: __import__("decimal").Decimal(i)}.get(kind, lambda i: i)
    data = [(name(i), t) for i, t in enumerate(texts)] + [(name(7), "a repeated id with a text of its own"), *[(None, words(20) + str(i)) for i in range(9)], (None, None)]
    order = sorted(((i, t or "") for i, t in data if i is not None), key=lambda r: r[1])
    order = sorted(order, key=lambda r: r[0], reverse=True) + sorted(((i, t or "") for i, t in data if i is None), key=lambda r: r[1])
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(t, edited), 12), round(plain_likeness(t, u), 12)))
    found = fingerprints.edited_likeness(spark.createDataFrame(data, f"doc_id {kind}, text string"))
    assert found.schema["doc_id"].dataType.simpleString() == ("bigint" if kind in ("long", "int") else kind)
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
