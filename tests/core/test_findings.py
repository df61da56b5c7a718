"""One test for each finding of a review: it failed before the finding was mended."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from alertmill.operators import anomaly, chain, components, correlate, entities, evaluate, graph, iforest, incidents, ingest, recut, techniques
from alertmill.operators.correlate import Correlation
from alertmill.plans import pipeline, registry
from alertmill.sources import shared

SF = "/root/testdata/sf0.001"


def test_vendor_rows_are_a_table_between_conversion_and_normalisation(spark):
    plan = registry.QUERIES["vendor_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and len(plan) < 100_000


def test_confidence_does_not_depend_on_the_order_of_summing(spark):
    scores = [0.3726, 0.5947, 0.3595, 0.4387]  # the mean over 0.75 is a tie, which a sum of floats in this order misses
    rows = spark.createDataFrame([(1, x) for x in scores] + [(2, 0.0)], "component long, link_score double").coalesce(1)
    assert {r[0]: r[2] for r in correlate.confidences(rows).collect()} == {1: 0.589, 2: 0.25}


def test_an_entity_in_every_alert_brings_no_rows_together(spark):
    rows = [(i, i, f"A{i}", f"I{i % 3}", None, "10.1.0.1" if i % 2 else f"10.2.0.{i % 50}", "10.0.0.53", f"u{i % 7}", None, None, f"r{i % 9}") for i in range(200)]
    members = spark.createDataFrame(rows, "pos long, us long, alert_id string, incident_id string, stage string, src_ip string, dst_ip string, user string, host string, process string, resource string")
    weights = entities.entity_stats(members)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        refs = graph._refs(members, weights, None)
        assert "hashpartitioning(n_" not in refs._jdf.queryExecution().executedPlan().toString()
        rare = {r[0] for r in weights.collect() if r["weight"] >= graph.LEAST_RARITY}
        for r in refs.collect():
            want = [(k, r[c]) for c, k in (("src_ip", "ip"), ("dst_ip", "ip"), ("user", "user"), ("host", "host"), ("process", "process"), ("resource", "resource"))]
            want = {c: f"{k}:{v}" for c, (k, v) in zip(("src_ip", "dst_ip", "user", "host", "process", "resource"), want, strict=True) if v is not None and f"{k}:{v}" in rare}
            assert {c: r[f"n_{c}"] for c in ("src_ip", "dst_ip", "user", "host", "process", "resource") if r[f"n_{c}"] is not None} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_words_are_made_of_the_strongest_edges_alone(spark):
    ends = [(1, 2, 0.5, "u1"), (1, 3, 0.7, "u2"), (2, 3, 0.7, "u3"), (4, 5, 0.4, None)]
    edges = spark.createDataFrame([(a, b, s, 0.5, 0.5, 0.5, 0.5, 0.5, 3.0, k and f"user:{k}", None, None, None, None) for a, b, s, k in ends], "a long, b long, score double, c_user double, c_host double, c_src_ip double, c_dst double, c_behavior double, minutes double, key_user string, key_host string, key_src_ip string, key_dst_ip string, key_resource string")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "pos long, component long")
    bare = correlate.memberships(groups, edges, reasons=False)
    assert "format_string" not in bare._jdf.queryExecution().optimizedPlan().toString() and "reasons" not in bare.columns
    full = {r["pos"]: r for r in correlate.memberships(groups, edges).collect()}
    assert {r["pos"]: (r["linked"], r["link_score"]) for r in bare.collect()} == {p: (r["linked"], r["link_score"]) for p, r in full.items()} == {1: (3, 0.7), 2: (3, 0.7), 3: (1, 0.7), 4: (5, 0.4), 5: (4, 0.4), 6: (None, 0.0)}
    assert full[3]["reasons"][0] == "shared user u2 (rarity 0.50)" and full[4]["reasons"] == ["3.0 min apart"] and full[6]["reasons"][0].startswith("no other alert")


def _crowd(spark, n=600):
    """Alerts over eight slots of pairs: few users, hosts and addresses, some at one instant, some whose two addresses are the same, nulls among them."""
    draw = random.Random(5)
    one = lambda *x: draw.choice(x)
    rows = [
        (i, 1_700_000_000_000_000 + draw.randrange(960) * 60_000_000, one("failed_login", "login_success", "powershell_execution", "odd", None), f"t{draw.randrange(4)}" if i % 9 else None, float(draw.randrange(100)) if i % 11 else None)
        + (one(None, *[f"u{x}" for x in range(9)]), one(None, *[f"H{x}" for x in range(7)]), one(None, *[f"10.0.0.{x}" for x in range(8)]), f"10.0.0.{draw.randrange(12)}", one(None, "r1", "r2"))
        for i in range(n)
    ]
    return shared.written(spark.createDataFrame(rows, "pos long, us long, alert_type string, title string, severity_score double, user string, host string, src_ip string, dst_ip string, resource string").withColumn("process", F.lit(None).cast("string")), "crowd")


def test_pairs_are_scored_where_they_meet(spark, monkeypatch):
    """every pair once and with the same score, no pair moved, also across batches and slots and where keys lie in two columns."""
    a = _crowd(spark)
    weights = shared.written(entities.entity_stats(a), "weights")
    hosts = spark.createDataFrame([(f"10.0.0.{x}", f"H{x % 7}") for x in range(6)], "ip string, host string")
    monkeypatch.setattr(correlate, "BATCH_PAIRS", 50)
    for at, cfg, few in ((None, Correlation(threshold=0.3, max_neighbors=4), 500), (hosts, Correlation(threshold=0.3, max_neighbors=4, min_weight=0.2), 1), (hosts, Correlation(threshold=0.35), 500)):
        monkeypatch.setattr(correlate, "FEW_TITLES", few)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        each = correlate.meeting(a, weights, at, cfg)
        met = [tuple(r) for r in correlate.met_pairs(each, cfg).collect()]
        edges = correlate.scored_edges(each, a, cfg)
        got = {(r["a"], r["b"]): r for r in edges.collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs = shared.written(correlate.candidate_pairs(correlate.keyed(a, weights, at, cfg), cfg), "pairs")
        assert len(met) == len(set(met)) and set(met) == {tuple(r) for r in pairs.collect()}
        want = {(r["a"], r["b"]): r for r in correlate.accepted_edges(correlate.scored_pairs(pairs, a, weights, ip_to_host=at), cfg).collect()}
        assert len(got) == edges.count() and 0 < len(want) < len(met) and {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in want.items()}
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan


def test_cutting_into_many_parts_grows_with_the_edges(spark):
    """a chain of weak and strong edges falls into 60,000 pairs and 1,000 chains of 20, which are cut again; each part was sought among all rows of its component."""
    n = 140_000
    a, i = np.arange(n - 1), np.arange(n - 1)
    score = np.where(i < 120_000, np.where(i % 2 == 0, 0.7, 0.3), np.where(i % 20 == 19, 0.3, 0.5 + 0.04 * (i % 2)))
    began = time.time()
    nodes, part = recut.cut_component(a, a + 1, score, np.ones(n - 1, bool), np.full(n - 1, 1023), np.full(n - 1, 1023), 10, (0.45, 0.50, 0.52))
    assert time.time() - began < 10 and (nodes == np.arange(n)).all()
    assert (part[:120_000] == nodes[:120_000] // 2 * 2).all() and len(np.unique(part[120_000:] // 20)) == 1000 and np.bincount(part).max() <= 10


def test_alerts_are_moved_once_for_their_features(spark, monkeypatch):
    from alertmill.sources.event_alerts import alerts, contexts

    monkeypatch.setattr(anomaly, "KEY_ROWS", 30)  # some keys by slots, others inside tasks
    rows = shared.written(alerts(spark, SF), "alerts")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = anomaly.features(rows, contexts(spark, SF)[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in exchanges if "hashpartitioning(user" in line or "hashpartitioning(src_ip" in line or "hashpartitioning(process" in line]


def test_windows_are_counted_alike_by_rows_by_slots_and_plainly(spark, monkeypatch):
    rng = random.Random(8)
    minute = 60_000_000
    rows = []
    for base in (-(2**60), -3 * 60 * minute, 0, 2**60):  # so far apart that keys must be counted in parts
        for _ in range(120):
            fail = rng.random() < 0.5
            rows.append((len(rows), base + rng.choice([rng.randrange(0, 300 * minute), rng.randrange(0, 300) * minute]), rng.choice(["a", "b", None]), rng.choice(["1", "2", "3", None]), rng.choice(["h", "i", "j", None]), int(fail), not fail))
    frame = spark.createDataFrame(rows, "pos long, us long, user string, src_ip string, host string, _fail int, _success boolean")

    def plain(r, key, value, m, of):
        seen = [x for x in rows if x[key] is not None and x[key] == r[key] and r[1] - m * minute <= x[1] <= r[1]]
        return sum(x[5] for x in seen) if of == "fails" else len({x[value] for x in seen} - {None})

    for key_rows, block in ((10**6, 10**6), (10**6, 7), (100, 7), (0, 7)):
        monkeypatch.setattr(anomaly, "KEY_ROWS", key_rows)
        monkeypatch.setattr(anomaly, "BLOCK_ROWS", block)
        got = {x["pos"]: x for x in anomaly.row_counts(frame).collect()}
        assert set(got) == {r[0] for r in rows if r[2] or r[3]}
        for r in rows:
            x = got.get(r[0])
            if r[2]:
                assert (x["fails_user_10m"], x["_hosts"] or 0) == (plain(r, 2, 4, 10, "fails"), plain(r, 2, 4, 60, "values"))
                assert not r[6] or x["_fails_30m"] == plain(r, 2, 4, 30, "fails")
            if r[3]:
                assert (x["fails_ip_10m"], x["_users"] or 0) == (plain(r, 3, 2, 10, "fails"), plain(r, 3, 2, 60, "values"))
    assert anomaly.row_counts(frame.limit(0)).collect() == []


def test_rounds_of_components_take_centres_of_stars_alone(spark, monkeypatch):
    rng = random.Random(3)
    edges = [("a", i, 10_000 + rng.randrange(40)) for i in range(2000) for _ in range(3)] + [("b", rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [("b", 20_000 + i, 20_001 + i) for i in range(200)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, ("a", None, 1), ("b", 4, 4)], "g string, a long, b long").repartition(6)
    want = {}
    for g in "ab":
        above = {x: x for h, a, b in edges if h == g and a != b for x in (a, b)}

        def root(x):
            while above[x] != x:
                x = above[x]
            return x

        for h, a, b in edges:
            if h == g and a != b:
                low, high = sorted((root(a), root(b)))
                above[high] = low
        want |= {(g, x): root(x) for x in above}
    monkeypatch.setattr(components, "CENTRES", 0)
    taken, rounds = [], components._rounds
    monkeypatch.setattr(components, "_rounds", lambda now, key, whole: (taken.append(now.count()), rounds(now, key, whole))[1])
    for sent in (10**6, 3):
        monkeypatch.setattr(components, "SENT_ROWS", sent)
        rows = components.connected_components(frame, within="g").collect()
        assert len(rows) == len(want) and {(r["g"], r["node"]): r["component"] for r in rows} == want
    assert max(taken) < 600  # 2,000 nodes of group a hang on one centre in each of six tasks
    assert components.connected_components(frame.filter("a = 4 and b = 4")).collect() == []


def test_entities_of_incidents_are_found_without_a_join_by_alert(spark):
    rows = [("A", "x", 0.5, 1), ("A", "y", 0.1, 2), ("A", "z", 0.2, 3), ("B", "x", 0.1, 1), ("B", "y", 0.0, 2), ("B", "z", 0.1, 3), ("B", "w", 0.1, 4)] + [("C", f"v{i}", 0.3, i + 1) for i in range(7)]
    found = incidents.primary_entities(spark.createDataFrame(rows, "incident_id string, value string, rarity double, place int"))
    got = {(r["incident_id"], r["value"]): r["primary_place"] for r in found.collect()}
    assert got == {("A", "x"): 1, ("A", "z"): 2, ("B", "x"): 1, ("B", "y"): 2, ("B", "z"): 3} | {("C", f"v{i}"): i + 1 for i in range(5)}
    plan = registry.QUERIES["incident_entities"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "(pos#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_factors_read_members_by_incident_without_a_shuffle(spark):
    """F18, F21 to F24: each factor moved all alerts to their incidents by itself."""
    members, factors = registry._factors(spark, SF)
    want = members.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(want) == factors.count() > 0 and "SelectedBucketsCount: 4 out of 4" in _plan(members.groupBy("incident_id").count())
    moved = [line for line in _plan(chain.chain_strength(chain.stage_rollup(chain.staged(members), evidence=False))).splitlines() if "Exchange hashpartitioning" in line]
    assert moved == [] and "Exchange hashpartitioning" not in _plan(anomaly.incident_anomaly(members, "rule_score"))


def test_techniques_are_equal_without_evidence(spark):
    rng, kinds = random.Random(5), ["failed_login", "login_new_source", "login_success_after_failures", "impossible_travel", "brute_force_detected", "password_spray_detected", "mailbox_access", "bulk_data_access", "account_discovery", "remote_service_login", "encoded_command"]
    rows = []
    for i in range(40):
        some = rng.sample(kinds, 4) + ["failed_login"] * 3
        for _ in range(60):
            attributes = rng.choice(["{}", '{"command_line": "net user /domain"}', '{"logon_type": "rdp"}', '{"vendor_techniques": ["T1059", "T1003"]}', '{"share": "s"}'] if i % 2 else ["{}"])
            rows.append((f"I{i}", len(rows), rng.randrange(1000), f"A{len(rows)}", rng.choice(some), rng.choice([None, *[f"u{j}" for j in range(i % 15 + 1)]]), rng.choice([None, "1.1.1.1", "10.0.0.1"][: i % 3 + 1]), rng.random() < 0.5, "v", attributes))
    m = spark.createDataFrame(rows, "incident_id string, pos long, us long, alert_id string, alert_type string, user string, src_ip string, src_ip_private boolean, vendor string, attributes string")
    m = m.withColumns({"dst_ip": F.lit(None).cast("string"), "process": F.lit(None).cast("string"), "resource": F.lit(None).cast("string")})
    full, bare = techniques.mapped(m), techniques.mapped(m, evidence=False)
    key = lambda df: sorted(map(tuple, df.select("incident_id", "technique_id", "confidence", "place").collect()))
    assert key(full) == key(bare) and {"T1110", "T1110.003", "T1087.002", "T1087", "T1021.001"} <= {r[1] for r in key(bare)}
    assert "evidence" not in bare.columns and "collect_list" not in _plan(bare) and full.filter("size(evidence) = 0").count() == 0


def test_alerts_move_without_texts_that_nobody_reads(spark):
    """user, address and process went through the shuffle by alert, for features that were made after it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(registry._featured(registry.alerts(spark, SF), spark, SF).select("pos", *registry._COLS, "process_rarity"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning(pos#" in line and "Project [" in lines[i + 1]]
    assert len(moved) == 1 and "novel_source#" in moved[0] and " src_ip#" not in moved[0].split("novel_source#")[1]
    plan = registry.forest_scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "(pos#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_equal_rows_have_equal_forest_scores_in_any_blocks(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("pos"), *[(F.xxhash64("id", F.lit(c)) % 3 + 3).cast("double").alias(c) for c in iforest.COLUMNS], F.lit("x").alias("more")).coalesce(1)
    forest = shared.written(iforest.fit(rows, trees=20), "forest")
    found = []
    for block in (10**6, 1):
        monkeypatch.setattr(iforest, "BLOCK_ROWS", block)
        found.append([tuple(r) for r in iforest.score(rows, forest, keep=("more",)).orderBy("pos").collect()])
    assert found[0] == found[1] and len(found[0]) == 3000 and {r[1] for r in found[0]} == {"x"} and iforest.score(rows.limit(0), forest).collect() == []


def test_raw_alerts_are_read_once_to_be_classified(spark, tmp_path):
    """accepted and rejected rows, with and without id, were each read and normalised by themselves."""
    rows = [(0, "a", "h", []), (1, "a", "g", []), (2, "b", "h", []), (3, None, "x", ["no id"]), (4, None, "x", ["no id"]), (5, "c", "k", ["bad"]), (6, "c", "k", []), (7, "d", "k", []), (8, "e", "s", []), (9, "z", "t", [])]
    spark.createDataFrame(rows, "pos long, alert_id string, content_hash string, errors array<string>").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    out = ingest.classified(raw)
    assert _plan(out).count("Scan parquet") == 1
    got = {r["pos"]: (r["status"], r["duplicate_of"], r["duplicate_count"], r["errors"]) for r in out.collect()}
    again = ["duplicate alert_id"]
    want = {0: ("accepted", None, 1, []), 1: ("rejected", None, 0, again), 2: ("duplicate", "a", 0, []), 3: ("rejected", None, 0, ["no id"]), 4: ("rejected", None, 0, ["no id"]), 5: ("rejected", None, 0, ["bad"]), 6: ("rejected", None, 0, again)}
    assert got == want | {7: ("accepted", None, 0, []), 8: ("accepted", None, 0, []), 9: ("accepted", None, 0, [])}
    known = spark.createDataFrame([("old", "s"), ("z", "q")], "alert_id string, content_hash string")
    late = {r["pos"]: (r["status"], r["duplicate_of"], r["duplicate_count"]) for r in ingest.classified(raw, known).collect()}
    assert late == {k: v[:3] for k, v in got.items()} | {8: ("duplicate", "old", 0), 9: ("duplicate", "z", 0)}


def test_truths_of_priorities_need_no_join_by_alert(spark):
    """F16: ground truth came back to its own alerts by two joins on alert_id."""
    rows = spark.createDataFrame([("I", "t", 1), ("I", "u", 2), ("I", "u", 3), ("J", "v", 4), ("J", "t", 5)], "incident_id string, gt_id string, n int")
    assert sorted(map(tuple, evaluate.dominant_of(rows).collect())) == [("I", "u", 2 / 3), ("J", "t", 0.5)]


def test_edges_without_words_are_made_of_numbers(spark, monkeypatch):
    """F1: tasks handed on both alerts' columns of every pair, to be scored outside, though only a, b, score and strong were kept."""
    a = _crowd(spark)
    weights = shared.written(entities.entity_stats(a), "weights")
    hosts = spark.createDataFrame([(f"10.0.0.{x}", f"H{x % 7}") for x in range(6)], "ip string, host string")
    for at, cfg in ((None, Correlation(threshold=0.3, max_neighbors=4)), (hosts, Correlation(threshold=0.35))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
        each = correlate.meeting(a, weights, at, cfg)
        bare = correlate.scored_edges(each, a, cfg, words=False)
        got = {(r["a"], r["b"]): (r["score"], r["strong"]) for r in bare.collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {(r["a"], r["b"]): (r["score"], r["strong"]) for r in correlate.scored_edges(each, a, cfg).collect()}
        assert len(got) == bare.count() > 0 and got.keys() == want.keys()
        assert all(abs(x - want[k][0]) < 1e-12 and s == want[k][1] for k, (x, s) in got.items())
        after = _plan(bare).split("MapInArrow")[0]  # nothing is left to do with what tasks hand on
        assert "Join" not in after and "exp(" not in after


def test_strongest_edges_inside_cut_groups(spark, monkeypatch):
    """all edges, from both ends, were joined twice by alert and moved again to find the strongest one of each."""
    monkeypatch.setattr(correlate, "STRETCH", 100)
    draw = random.Random(11)
    edges = {(a, b): draw.randrange(35, 60) / 100 for a, b in (sorted(draw.sample(range(200), 2)) for _ in range(1500))}
    group = {n: draw.randrange(3) if n % 4 else 3 + n for n in range(210)}  # some alone, so that all of their edges lead out
    want = {}
    for (a, b), score in edges.items():
        for x, y in ((a, b), (b, a)):
            if group[x] == group[y]:
                want[x] = max(want.get(x, (0, 0)), (score, -y))
    table = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, score double").repartition(3)
    groups = spark.createDataFrame(list(group.items()), "pos long, component long")
    got = {r["pos"]: (r["score"], -r["linked"]) for r in correlate.strongest(groups, table).collect()}
    assert got == want and 0 < len(want) < 200
    kept = {r["pos"]: (r["link_score"], r["linked"]) for r in correlate.memberships(groups, table, reasons=False).collect()}
    assert kept == {n: (want[n][0], -want[n][1]) if n in want else (0.0, None) for n in group}
    # a node's edges of one task are one row
    near = spark.createDataFrame([(0, b, b / 100) for b in range(1, 91)], "a long, b long, score double").coalesce(1)
    assert sorted(tuple(r) for r in correlate._tops(near).filter("pos = 0").collect()) == [(0, 90, 0.9)]


def test_incidents_are_ranked_without_reasons_and_evidence(spark, monkeypatch):
    """F1: reasons of all memberships, and the evidence of all stages and techniques, were made before incidents were ranked, and forest scores twice."""
    a = registry.alerts(spark, SF)
    users, hosts, _ = registry.contexts(spark, SF)
    asked, scored = [], []
    reasons, mapped, score = correlate.edge_reasons, techniques.mapped, iforest.score
    monkeypatch.setattr(correlate, "edge_reasons", lambda *x: asked.append("reasons") or reasons(*x))
    monkeypatch.setattr(techniques, "mapped", lambda *x, evidence=True, **k: (asked.append("evidence") if evidence else None) or mapped(*x, evidence=evidence, **k))
    monkeypatch.setattr(iforest, "score", lambda *x, **k: scored.append(score(*x, **k)) or scored[-1])
    out = pipeline.analyze(a, users, hosts, registry.CFG)
    n = out.incidents.count()
    assert n > 0 and asked == [] and "MapInArrow" not in out.members._jdf.queryExecution().optimizedPlan().toString()
    assert "SelectedBucketsCount: 4 out of 4" in _plan(out.members.groupBy("incident_id").count())
    told = out.memberships.collect()
    assert asked == ["reasons"] and len(told) == a.count() and all(r["reasons"] for r in told)
    near = [r for r in told if r["linked"] is not None]
    assert near and all("min apart" in " ".join(r["reasons"]) for r in near) and all(r["reasons"][0].startswith("no other") for r in told if r["linked"] is None)
    assert out.mappings.select("evidence").count() > 0 and asked == ["reasons", "evidence"]
