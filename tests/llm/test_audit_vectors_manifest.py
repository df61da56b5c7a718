import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from alertmill.llm import audit, manifest, vectors

DOCS = "doc_id long, text string, source string, n_chars string, digest int, part int"


# --- filter interaction audit -------------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = {i for i, q, t in labels if q == 1}, {i for i, q, t in labels if t == 1}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, source, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": first is not None and (i is None or i > first),
        }
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        found, total = [], {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, x in enumerate(order):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                failing = sum(r[0][x] for r in rows)
                alone = sum(r[0][x] and not any(r[0][y] for y in "ABCDE" if y != x) for r in rows)
                total[x] = total.get(x, 0) + len(gone)
                found.append((x, part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*f[1:], total[f[0]]) for f in found]
    return sorted(out)


def test_audit_equals_step_by_step_filtering(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \t", "x", "A B", "word " * 60, "a#b", " ".join(f"w{i}" for i in range(50)), "\n".join(f"w{i}" for i in range(49)), "É Z " + " ".join(f"w{i}" for i in range(70)), "w " * 20000 + "|"]
    docs = [(int(i), texts[rng.integers(len(texts))], [None, "", "a", "b'"][rng.integers(4)], "x", 1, 2) for i in rng.permutation(300)]
    docs += [docs[0], docs[0], (docs[1][0], docs[1][1], "other", "x", 1, 2), (None, "only without id", "a", "x", 1, 2), (None, "only without id", "a", "x", 1, 2), (None, "x", "b'", "x", 1, 2)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 310, 3)] + [(None, 1, 1), (0, None, None), (6, None, 1)]
    seen = {}
    for i, q, t in labels:
        a, b = seen.get(i, (0, 0))
        seen[i] = (max(a, q or 0), max(b, t or 0))
    frame = spark.createDataFrame(docs, DOCS)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.filter_audit(frame, told).collect())
    assert got == brute_audit(docs, [(i, *x) for i, x in seen.items() if i is not None])
    assert audit.filter_audit(frame.limit(0), told).collect() == []
    assert audit.filter_audit(frame, told.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


# --- vectors ------------------------------------------------------------------------------------------


def brute_links(rows, least):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    units = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok(v) else None for _, v, _ in rows]
    links = [[j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] is not None and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), c, rows[i][0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [5, 1024])
def test_vector_links_are_those_of_all_pairs(spark, chunk):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(12):
        centre = rng.normal(size=20)
        rows += [[(centre + rng.normal(size=20) * s).tolist(), k % 3] for s in rng.uniform(0, 0.35, size=int(rng.integers(1, 25)))]
    centre = rng.normal(size=20)
    rows += [[(centre + rng.normal(size=20) * 0.1).tolist(), 1] for _ in range(150)] + [[centre.tolist(), x] for x in (1, 1, 1, 2, None, None)]
    rows += [[(centre * 1e-170).tolist(), 1], [(centre * 1e170).tolist(), 1], [centre[:19].tolist(), 1], [[], 1], [None, 1], [[0.0] * 20, 1], [[0.0] * 20, 1], [[None] * 20, 1]]
    rows += [[[float("nan")] * 20, 1], [[float("inf")] * 20, 1], [[2.0], 1], [[5.0], 1], [[-1.0], 1]]
    rows = [(int(i), v, lab) for i, (v, lab) in zip(rng.permutation(len(rows)), rows, strict=True)]
    rows += [rows[0], rows[0], (None, rows[3][1], rows[3][2]), (None, rng.normal(size=20).tolist(), 2)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n int, node int")
    got = sorted((tuple(r) for r in vectors.near_duplicate_vectors(frame, chunk=chunk).collect()), key=repr)
    assert got == brute_links(rows, 0.93)
    assert vectors.near_duplicate_vectors(frame.limit(0)).collect() == []


def test_buckets_meet_near_the_least_cosine():
    rng = np.random.default_rng(3)
    for d, cos in ((64, 0.93), (64, 0.95), (100, 0.93)):
        x, z = vectors.units(rng.normal(size=(2000, d))), rng.normal(size=(2000, d))
        z = vectors.units(z - (z * x).sum(1)[:, None] * x)
        a, b = vectors.bucket_codes(x), vectors.bucket_codes(cos * x + np.sqrt(1 - cos * cos) * z)
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b, strict=True)]) >= 0.998
    h = vectors.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and set(np.round(np.abs(h).ravel() * np.sqrt(8), 9)) == {1.0}


def test_large_groups_make_no_pairs(spark):
    """A group of near copies: rows grow with its chunks, not with its pairs."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=64)
    frame = spark.createDataFrame([(i, (centre + rng.normal(size=64) * 0.05).tolist(), 0) for i in range(600)], "vec_id long, embedding array<double>, label int")
    _, reps = vectors.representatives(frame, "vec_id", "embedding", "label")
    codes = vectors.coded(reps, 8, 3, 4)
    assert vectors.in_blocks(codes, 200).count() <= 600 * 32 * 5
    got = vectors.near_duplicate_vectors(frame, chunk=200).collect()
    assert all(r["n_links"] == 599 and r["component_id"] == 0 and r["kept"] == (r["vec_id"] == 0) for r in got)


# --- Merkle manifest ----------------------------------------------------------------------------------


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def beside(levels, p):
    out = []
    for level in levels[:-1]:
        start = p // 3 * 3
        out.append(("".join(level[start:p]), "".join(level[p + 1 : start + 3])))
        p //= 3
    return out


def brute_manifest(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(text(r[c]) for c in manifest.FIELDS))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for p, r in enumerate(by[s]):
            way, now = beside(trees[s], p) + beside(top, k), dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                now["text"] = r["text"].replace("\n", "")
            x = leaf(now)
            for a, b in way:
                x = digest(a + x + b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in way)), x, x == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos int, block int"


@pytest.mark.parametrize(("levels", "n"), [(5, 700), (1, 200), (2, 81), (2, 1), (2, 9), (2, 10)])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels, n):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    source = lambda i: None if i % 7 == 0 else "" if i % 7 == 1 else "é" if i % 7 == 2 else "z" if i % 2 else f"s{i % 31}"
    data = [(i, source(i) if n > 1 else "one", "en" if i % 3 else None, i % 5 or None, None if i % 11 == 0 else "a\nü" * (i % 4), 1, 1, 1) for i in range(n)]
    if n == 700:
        data += [data[5], data[5], (5, *data[5][1:4], "other", 1, 1, 1), (None, "z", None, None, "x\n", 1, 1, 1), (None, None, None, None, None, 1, 1, 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
