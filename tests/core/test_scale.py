"""Plans for keys, components and histories of any size, against plain Python."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.operators import anomaly, components, correlate, iforest, search, similarity, views
from alertmill.operators.correlate import Correlation
from alertmill.sources import tables

MINUTE = 60_000_000


def plain_components(edges):
    above = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    return {x: root(x) for x in above}


# --- trailing windows ---------------------------------------------------------------------------------


def plain_counts(rows):
    """rows: (us, user, ip, host, fail, success)"""
    out = {}
    for side, key in (("u", 1), ("i", 2)):
        for r in rows:
            if r[key] is None:
                continue
            seen = [x for x in rows if x[key] == r[key] and r[0] - 60 * MINUTE <= x[0] <= r[0]]
            value = 3 if side == "u" else 1
            fails = lambda m: sum(x[4] for x in seen if x[0] >= r[0] - m * MINUTE)  # noqa: E731, B023
            success = any(x[5] for x in seen if x[0] == r[0])
            out[side, r[key], r[0]] = (fails(10), fails(30) if side == "u" and success else None, len({x[value] for x in seen if x[value] is not None}))
    return out


def test_trailing_counts_are_those_of_frames(spark):
    rng = random.Random(5)
    rows = []
    for base in (-3 * 3_600_000_000, 0, 1_700_000_000_000_000):
        for _ in range(220):
            us = base + rng.choice([rng.randrange(0, 5 * 3_600_000_000), rng.randrange(0, 300) * MINUTE])
            fail = rng.random() < 0.5
            rows.append((us, rng.choice(["a", "b", None]), rng.choice(["1", "2", "3", None]), rng.choice(["h", "i", "j", "k", None]), int(fail), not fail and rng.random() < 0.7))
    rows += [rows[3], rows[4], rows[4]]
    frame = spark.createDataFrame(rows, "us long, user string, src_ip string, host string, _fail int, _success boolean")
    got = {(r["side"], r["key"], r["us"]): (r["fails_10m"], r["fails_30m"], r["others"] or 0) for r in anomaly.trailing_counts(frame).collect()}
    assert got == plain_counts(rows)
    assert anomaly.trailing_counts(frame.limit(0)).collect() == []


def test_one_address_with_200_000_alerts_in_an_hour(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 18_000).alias("us"), F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(5000))).alias("user"), F.lit("9.9.9.9").alias("src_ip"), F.lit(None).cast("string").alias("host"), (F.col("id") % 3 == 0).cast("int").alias("_fail"), F.lit(False).alias("_success"))
    start = time.time()
    got = anomaly.trailing_counts(rows).filter("side = 'i'").toPandas().sort_values("us")
    assert time.time() - start < 60  # a frame for each row took minutes
    us = np.arange(n) * 18_000
    fails = np.concatenate([[0], np.cumsum(np.arange(n) % 3 == 0)])
    low = np.searchsorted(us, us - 10 * MINUTE)
    assert (got["fails_10m"].to_numpy() == fails[1:] - fails[low]).all()
    users = rows.select("user").toPandas()["user"]
    assert got["others"].iloc[-1] == users.nunique() and got["others"].iloc[99] == users[:100].nunique()


# --- components and re-cuts ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_random_graphs(spark, monkeypatch, kind):
    rng = random.Random(2)
    name = (lambda i: i) if kind == "long" else (lambda i: f"é{i}" if i % 3 else f"n{i}")
    edges = [(name(rng.randrange(400)), name(rng.randrange(400))) for _ in range(260)] + [(name(i), name(i + 1)) for i in range(1000, 1300)] + [(name(2000), name(i)) for i in range(2001, 2200)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, name(1)), (name(1), None), (name(5), name(5))], f"a {kind}, b {kind}").repartition(5)
    for stretch in (20, 500_000):
        monkeypatch.setattr(components, "STRETCH", stretch)
        got = components.connected_components(frame).collect()
        want = plain_components([(a, b) for a, b in edges if a != b])
        assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    whole = components.connected_components(frame, whole=10**6).collect()
    assert len(whole) == len(want) and {r["node"]: r["component"] for r in whole} == want
    both = frame.withColumn("of", F.lit("x")).unionByName(frame.filter(F.col("a") < F.col("b")).withColumn("of", F.lit("y")))
    apart = components.connected_components(both, within="of").collect()
    assert {r["node"]: r["component"] for r in apart if r["of"] == "x"} == want
    assert {r["node"]: r["component"] for r in apart if r["of"] == "y"} == plain_components([(a, b) for a, b in edges if a < b])


def test_tasks_leave_few_rounds(spark, monkeypatch):
    """Stretches of a long path meet as stars: two rounds where the edges alone took several."""
    rounds = []
    star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda *a: rounds.append(1) or star(*a))
    path = spark.range(3000, numPartitions=3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.connected_components(path).collect()} == {0}
    assert len(rounds) <= 2


def test_cuts_in_tasks_are_those_in_rounds(spark):
    rng = random.Random(8)
    rows, groups = [], []
    for c in range(2):
        n = rng.choice([30, 45])
        base = 100 * c
        edges = {(base + i, base + rng.randrange(i)) for i in range(1, n)} | {tuple(sorted(rng.sample(range(base, base + n), 2))[::-1]) for _ in range(2 * n)}
        rows += [(min(e), max(e), rng.choice([0.41, 0.47, 0.52, 0.58, 0.66, 0.7]) + rng.random() / 100, rng.random() < 0.8) for e in sorted(edges)]
        groups += [(base + i, base) for i in range(n)]
    e = spark.createDataFrame(rows, "a long, b long, score double, strong boolean")
    g = spark.createDataFrame(groups, "pos long, component long")
    cfg = Correlation(max_component=8)
    ways = [{r["pos"]: r["component"] for r in correlate.recut(g, e, cfg, whole_edges=k).collect()} for k in (10**6, 0)]
    same = lambda of: sorted(sorted(p for p in of if of[p] == c) for c in set(of.values()))
    assert len(ways[0]) == len(groups) and same(ways[0]) == same(ways[1])
    assert all(min(p for p in ways[0] if ways[0][p] == c) == c for c in set(ways[0].values()))
    assert max(collections.Counter(ways[0].values()).values()) < 45


# --- streams ------------------------------------------------------------------------------------------


def test_a_batch_does_not_read_what_came_before(spark, tmp_path):
    from test_units import BASE, raw

    from alertmill.streaming import stream

    root = str(tmp_path)
    rows = lambda *ids: [BASE | {"alert_id": f"A{i}", "timestamp": 1_700_000_000_000 + 1000 * i, "user": f"u{i}"} for i in ids]
    batches = [
        rows(*range(30)) + [rows(3)[0]] + [rows(4)[0] | {"alert_id": "copy"}],
        rows(*range(20, 40)) + [rows(1)[0] | {"alert_id": "again"}, rows(2)[0] | {"user": "other"}, rows(90)[0] | {"src_ip": "300.0.0.1"}],
        [rows(2)[0] | {"alert_id": "late", "user": "other"}, rows(35)[0] | {"alert_id": "B"}] + rows(50),
    ]
    call = stream.ingest_batch(root)
    for n, batch in enumerate(batches):
        made = raw(spark, *batch)
        made.withColumn("pos", F.col("pos") + 1000 * n).select("pos", "alert_id", "timestamp", "alert_type", "severity", "severity_score", "confidence", "user", "src_ip").coalesce(1).write.mode("append").parquet(f"{root}/in")
        schema = spark.read.parquet(f"{root}/in").schema
        stream.run_available(stream.source(spark, f"{root}/in", schema), call, f"{root}/check")
        if n == 0:  # a batch that is run again changes nothing
            first = sorted(tuple(r) for r in stream.drained(spark, root).select("alert_id", "duplicate_count").collect())
            call(spark.read.schema(schema).parquet(f"{root}/in"), 0)
            assert sorted(tuple(r) for r in stream.drained(spark, root).select("alert_id", "duplicate_count").collect()) == first and len(first) == 30
            kept = list((tmp_path / "stream_alerts/batch=0").glob("*.parquet"))
            away = [f.rename(tmp_path / f.name) for f in kept]  # what is stored is not there while the next batch runs
        if n == 1:
            for f, to in zip(away, kept, strict=True):
                f.rename(to)
    got = {r["alert_id"]: r["duplicate_count"] for r in stream.drained(spark, root).collect()}
    assert set(got) == {f"A{i}" for i in (*range(40), 50)} | {"late"}
    assert [got[f"A{i}"] for i in (1, 2, 4, 25, 35)] == [1, 1, 1, 1, 1] and got["A5"] == 0
    c = stream.counters(spark, root).first()
    assert (c["received"], c["accepted"], c["duplicates"], c["rejected"]) == (58, 42, 14, 2)


# --- isolation forest ---------------------------------------------------------------------------------


def test_draws_take_each_tree_alike(spark):
    n, trees, share = 60_000, 200, 0.01
    got = iforest.draws(spark.range(n).withColumn("x", F.lit(1.0)), share, trees, 7).toPandas()
    assert got.duplicated(["id", "tree"]).sum() == 0
    by_tree, by_row = np.bincount(got["tree"], minlength=trees), np.bincount(np.bincount(got["id"], minlength=n), minlength=12)[:12]
    assert abs(len(got) - n * trees * share) < 5 * (n * trees * share) ** 0.5
    assert ((by_tree - n * share) ** 2 / (n * share)).sum() < trees + 5 * (2 * trees) ** 0.5
    want = [n * math.comb(trees, k) * share**k * (1 - share) ** (trees - k) for k in range(6)]
    assert all(abs(a - b) < 5 * b**0.5 for a, b in zip(by_row, want, strict=False))
    both = got[got["tree"].isin([0, 1])].groupby("id").size()
    assert (both == 2).sum() < 25  # neighbours are independent: six expected
    again = iforest.draws(spark.range(n).repartition(7).withColumn("x", F.lit(1.0)), share, trees, 7).toPandas()
    assert set(zip(got["id"], got["tree"])) == set(zip(again["id"], again["tree"]))
    assert iforest.draws(spark.range(5), 1.0, 4, 7).count() == 20 and iforest.draws(spark.range(0), 0.5, 4, 7).count() == 0


# --- merges -------------------------------------------------------------------------------------------


def files_of(root):
    return {str(f): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def test_merges_leave_other_days_alone(spark, tmp_path):
    day = 86_400_000_000
    base = spark.range(40).select(F.concat(F.lit("A"), "id").alias("alert_id"), F.when(F.col("id") < 36, F.timestamp_micros(F.col("id") % 4 * day)).alias("ts"), F.lit(0).cast("long").alias("duplicate_count"))
    tables.append_alerts(base, str(tmp_path))
    before = files_of(tmp_path)
    dup = lambda i, of, d, status="duplicate": (f"D{i}", status, of, d)
    rows = spark.createDataFrame([dup(0, "A1", 1), dup(1, "A1", 1), dup(2, "A5", 1), dup(3, "A2", 1), dup(4, "nowhere", 1), dup(5, "A9", 1, "rejected"), dup(6, None, 1)], "alert_id string, status string, duplicate_of string, d long")
    rows = rows.withColumn("ts", F.timestamp_micros(F.col("d") * day))
    days = tables.raise_duplicates(spark, str(tmp_path), rows, 7)
    assert sorted(str(d) for d in days) == ["1970-01-02", "1970-01-03"]  # A2 repeats an id of another day
    for _ in range(2):  # again, as after a failure
        got = {r["alert_id"]: r["duplicate_count"] for r in tables.read(spark, str(tmp_path), "alerts").collect()}
        assert len(got) == 40 and {k: v for k, v in got.items() if v} == {"A1": 2, "A5": 1, "A2": 1}
        after = files_of(tmp_path)
        same = [f for f in before if "day=1970-01-01" in f or "day=1970-01-04" in f or "HIVE_DEFAULT" in f]
        assert same and all(after[f] == before[f] for f in same)
        tables.raise_duplicates(spark, str(tmp_path), rows, 7)
    tables.raise_duplicates(spark, str(tmp_path), spark.createDataFrame([("E", "duplicate", "A37", None), ("F", "duplicate", "A1", None)], "alert_id string, status string, duplicate_of string, d long").withColumn("ts", F.timestamp_micros("d")), 8)
    got = {r["alert_id"]: r["duplicate_count"] for r in tables.read(spark, str(tmp_path), "alerts").collect()}
    assert {k: v for k, v in got.items() if v} == {"A1": 3, "A5": 1, "A2": 1, "A37": 1}
    assert tables.raise_duplicates(spark, str(tmp_path), rows.limit(0), 9) == []


def test_gaps_are_appended(spark, tmp_path):
    stored = spark.createDataFrame([("a", "ok", 1), ("b", "failed", 2)], "k string, status string, v int")
    tables.replace(stored, str(tmp_path), "decision_runs")
    before = files_of(tmp_path)
    incoming = spark.createDataFrame([("a", "ok", 9), ("b", "ok", 8), ("c", "ok", 7), ("c", "ok", 7), (None, "ok", 6)], "k string, status string, v int")
    for _ in range(2):
        tables.append_gaps(spark, str(tmp_path), "decision_runs", incoming.filter("k is not null"), ["k"], only_ok=True)
        assert sorted((r["k"], r["v"]) for r in tables.read(spark, str(tmp_path), "decision_runs").collect()) == [("a", 1), ("b", 2), ("b", 8), ("c", 7)]
    assert all(files_of(tmp_path)[f] == t for f, t in before.items())


# --- titles and search --------------------------------------------------------------------------------


def test_similar_titles_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["failed", "sign-in", "sign-ins", "from", "host", "powershell", "power", "unusual", "exécution", "of", "a", "x"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(150)] + [None, "", "  ", "Failed Host", "failed host"]
    frame = spark.createDataFrame([(t, 1) for t in titles], "title string, gram int")
    every = {(r["a"], r["b"]): r["similarity"] for r in similarity.title_similarity(frame).collect()}
    for least in (0.3, 0.7, 1.0 - 1e-9):
        got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_titles(frame, least).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if v >= least}) and ("Failed Host", "failed host") in got
    assert similarity.similar_titles(frame.limit(0), 0.5).collect() == []


def test_search_through_the_index(spark, tmp_path):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(i, f"ALT-{i:04d}" + pick("", "-DUP", "x"), pick("PowerShell ran", "Failed sign-in", None, "é power"), pick("ann", "bob.power", None), pick("HOST-1", "POWER-9", None), pick("10.0.0.1", "10.30.0.7", None), pick("powershell_execution", "failed_login"), i % 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "pos long, alert_id string, title string, user string, host string, src_ip string, alert_type string, d int").withColumn("ts", F.when(F.col("d") < 4, F.timestamp_micros(F.col("d") * 86_400_000_000)))
    search.write_index(frame, str(tmp_path))
    dated = frame.withColumn("day", F.to_date("ts"))
    for q in ("power", "POWER", "é pow", "10.3", "0.30", "dup", "DUP", "x", "ALT-0012", "nothing here", "login", "ell ran"):
        for a in (frame, dated):
            assert {r["pos"] for r in search.search(a, str(tmp_path), q).collect()} == {r["pos"] for r in views.search_alerts(frame, q).collect()}, q
    assert search.search(frame, str(tmp_path), "power", host="power-9").count() == views.search_alerts(frame, "power", host="power-9").count() > 0
    want = search.found_places(spark, str(tmp_path), "0012").count()
    mine = search._buckets_of(spark, ["001", "012"])
    for f in (tmp_path / "grams").glob("bucket=*/*.parquet"):  # other folders are not opened
        if f.parent.name not in {f"bucket={b}" for b in mine}:
            f.write_bytes(b"")
    assert search.matching_values(spark, str(tmp_path), "0012").count() == want > 0
