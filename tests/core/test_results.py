"""Stored batches, enrichment, reads of results and small reports, on fixtures with nulls, ties and empty tables."""

import json

import pytest
from pyspark.sql import functions as F
from test_units import BASE, raw

from alertmill.functions import normalize
from alertmill.operators import briefs, evaluate, ingest, techniques, views
from alertmill.plans import pipeline
from alertmill.sources import readers, tables


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_batches_are_stored_once(spark, tmp_path):
    root = str(tmp_path)
    at = lambda i, day=1, **more: BASE | {"alert_id": f"A{i}", "timestamp": f"2026-09-0{day}T10:00:{i % 60:02d}Z"} | more
    first = ingest.classified(normalize.normalize(raw(spark, at(1), at(2), at(3, 2), at(1) | {"alert_id": "copy"}, *[BASE | {"alert_id": f"R{i}", "severity": "odd"} for i in range(205)], at(2, user="other"))))
    for _ in range(2):  # again, as after a failure
        pipeline.store_batch(first, root, "B1", 1, "file.json")
        log = tables.read(spark, root, "ingest_batches").collect()
        assert [(r["batch_id"], r["source_name"], r["received"], r["accepted"], r["duplicates"], r["rejected"]) for r in log] == [("B1", "file.json", 210, 3, 1, 206)]
        assert [r["alert_id"] for r in log[0]["rejected_rows"]] == [f"R{i}" for i in range(200)] and log[0]["rejected_rows"][0]["errors"] == ["unknown severity"]
        assert rows_of(tables.read(spark, root, "alerts").select("alert_id", "duplicate_count"), "alert_id") == [("A1", 1), ("A2", 0), ("A3", 0)]
    known = tables.read(spark, root, "alerts").select("alert_id", "content_hash")
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "alerts/day=2026-09-02").glob("*.parquet")}
    second = ingest.classified(normalize.normalize(raw(spark, at(1) | {"alert_id": "again"}, at(2), at(4), at(4) | {"alert_id": "inside"})), known)
    second.write.parquet(f"{root}/second")
    for _ in range(2):
        pipeline.store_batch(spark.read.parquet(f"{root}/second"), root, "B2", 2)
        assert rows_of(tables.read(spark, root, "alerts").select("alert_id", "duplicate_count"), "alert_id") == [("A1", 2), ("A2", 1), ("A3", 0), ("A4", 1)]
    assert tables.read(spark, root, "ingest_batches").count() == 2 and all(f.stat().st_mtime_ns == t for f, t in untouched.items()) and untouched
    pipeline.store_batch(first.limit(0), root, "B3", 3)
    assert tables.read(spark, root, "alerts").count() == 4


def test_contexts_and_defaults(spark):
    users = spark.createDataFrame([("u", 4), ("u", 4), ("low", -3)], "user string, privilege int")
    hosts = spark.createDataFrame([("H1", 2), ("H9", None)], "host string, criticality int")
    resources = spark.createDataFrame([("erp", 5)], "resource string, criticality int")
    made = [
        BASE | {"alert_id": "both", "host": "h1.corp.local", "resource": "ERP"}, BASE | {"alert_id": "host", "host": "h1"}, BASE | {"alert_id": "none", "user": None, "host": "unknown"}, BASE | {"alert_id": "null", "host": "h9"},
        BASE | {"alert_id": "given", "host": "h1", "asset_criticality": 4, "user_privilege": 9}, BASE | {"alert_id": "zero", "asset_criticality": 0, "user_privilege": 0}, BASE | {"alert_id": "low", "user": "low"},
    ]
    got = {r["alert_id"]: (r["asset_criticality"], r["user_privilege"]) for r in normalize.normalize(raw(spark, *made), users, hosts, resources).collect()}
    assert got == {"both": (5, 4), "host": (2, 4), "none": (1, 1), "null": (1, 4), "given": (4, 5), "zero": (1, 1), "low": (1, 1)}
    plain = {r["alert_id"]: r for r in normalize.normalize(raw(spark, {k: v for k, v in BASE.items() if k != "confidence"}, BASE | {"alert_id": "odd", "alert_type": "own_type", "title": "T", "source": "s", "vendor": "v"})).collect()}
    a, odd = plain["A1"], plain["odd"]
    assert (a["vendor"], a["asset_criticality"], a["user_privilege"]) == ("unknown", 1, 1) and a["source"] not in (None, "unknown") and a["title"]
    assert (odd["source"], odd["title"], odd["vendor"], odd["severity"]) == ("s", "T", "v", "low")
    none = normalize.normalize(raw(spark, BASE | {"alert_type": "own_type"})).first()
    assert (none["source"], none["title"]) == ("unknown", "own_type")


INCIDENTS = "incident_id string, incident_name string, title string, risk_score double, severity string, status string, first_us long, last_us long, n_alerts long, technique_ids array<string>, evidence_hash string"


def test_incident_queue_and_assembly(spark):
    data = [("C1", "INC-0001", "Spray from X", 90.0, "critical", "new", 5, 9, 3, ["T1110"], "e1"), ("C2", "INC-0002", "travel", 90.0, "high", "triaged", 4, 8, 7, None, "e2"), ("C3", "INC-0003", None, 20.0, "low", "closed", 1, 2, 1, [], "e3")]
    i = spark.createDataFrame(data, INCIDENTS)
    names = lambda **k: [r["incident_id"] for r in views.incident_queue(i, **k).collect()]
    assert names() == ["C2", "C1", "C3"] and names(sort="recent") == ["C1", "C2", "C3"] and names(sort="alerts") == ["C2", "C1", "C3"]
    assert names(min_risk=20.5) == ["C2", "C1"] and names(severities=["low", "high"]) == ["C2", "C3"] and names(statuses=["new"]) == ["C1"]
    assert names(q="SPRAY") == ["C1"] and names(q="0003") == ["C3"] and names(technique="t1110") == ["C1"] and names(q="nothing") == []
    stages = spark.createDataFrame([("C1", 7, 2, "s2", "S2", 1, 0.5), ("C1", 7, 1, "s1", "S1", 2, 0.5), ("C1", 3, 9, "s9", "S9", 2, 0.5)], "incident_id string, first_us long, stage_order int, stage string, label string, n_alerts long, confidence double")
    maps = spark.createDataFrame([("C1", 2, "T2", "b", 0.5, "r"), ("C1", 1, "T1", "a", 0.9, "r")], "incident_id string, place int, technique_id string, name string, confidence double, reason string")
    ents = spark.createDataFrame([("C2", 1, "user", "u", "actor", 3, 0.4)], "incident_id string, place int, type string, value string, role string, n_alerts long, rarity double")
    got = {r["incident_id"]: r for r in views.assembled(i, stages, maps, ents).collect()}
    assert len(got) == 3 and [s["stage"] for s in got["C1"]["stages"]] == ["s9", "s1", "s2"] and [t["technique_id"] for t in got["C1"]["techniques"]] == ["T1", "T2"]
    assert got["C1"]["entities"] is None and got["C2"]["entities"][0]["value"] == "u" and got["C3"]["stages"] is None
    alerts = spark.createDataFrame([("A",), ("B",)], "alert_id string")
    links = spark.createDataFrame([("A", "C1")], "alert_id string, incident_id string")
    assert rows_of(views.with_membership(alerts, links), "alert_id") == [("A", "C1"), ("B", None)] and views.with_membership(alerts, links, "inner").count() == 1
    assert views.assembled(i.limit(0), stages, maps, ents).count() == 0


def test_contexts_of_briefs(spark):
    ents = [("C1", "user", f"u{k}", k) for k in range(9)] + [("C1", "user", "u1", 0), ("C1", "host", "H1", 3), ("C1", "ip", "1.1.1.1", 1), ("C2", "resource", "erp", 1), ("C2", "user", "nobody", 2)]
    e = spark.createDataFrame(ents, "incident_id string, type string, value string, place int")
    users, hosts, res = spark.createDataFrame([(f"u{k}", k) for k in range(9)], "user string, privilege int"), spark.createDataFrame([("H1", 4)], "host string, criticality int"), spark.createDataFrame([("erp", 5)], "resource string, criticality int")
    got = rows_of(briefs.asset_context(e, users, hosts, res).select("incident_id", "type", "value", "level", "place"), "incident_id", "type", "place")
    assert got == [("C1", "host", "H1", 4, 1), *[("C1", "user", f"u{k}", k, n + 1) for n, k in enumerate([0, 1, 2, 3, 4, 5])], ("C2", "resource", "erp", 5, 1)]
    known = spark.createDataFrame([("T1", "n", ["a"], "d" * 400), ("T2", "m", ["b"], None)], "technique_id string, name string, tactics array<string>, description string")
    maps = spark.createDataFrame([("C1", "T1"), ("C1", "T2"), ("C1", "T3")], "incident_id string, technique_id string")
    assert [(r["technique_id"], r["description"]) for r in briefs.technique_context(maps, known).orderBy("technique_id").collect()] == [("T1", "d" * 300), ("T2", None)]


def test_reports(spark):
    r = spark.createDataFrame([("p", "fact", "1"), ("p", "fact", "0"), ("p", "fact", "1"), ("p", "fact", "?"), ("p", "hypothesis", "0"), ("q", "fact", None), ("s", "fact", "0")], "provider string, kind string, rating string")
    assert rows_of(evaluate.claim_rates(r), "provider") == [("p", 3, 0.6667), ("s", 1, 0.0)] and evaluate.claim_rates(r.limit(0)).count() == 0
    b = spark.createDataFrame([(False, True, 4, 1), (True, True, 0, 0), (False, False, 4, 1)], "fallback boolean, schema_valid boolean, citations_checked long, invalid_citations long")
    assert tuple(evaluate.brief_metrics(b).first()) == (3, 1, 0.6667, 0.75)
    assert evaluate.brief_metrics(b.limit(0)).first()["briefs"] == 0
    v = spark.createDataFrame([("benign",), ("benign",), ("true_positive",), (None,)], "verdict string")
    assert rows_of(views.verdict_counts(v), "verdict") == [(None, 1), ("benign", 2), ("true_positive", 1)]
    d = spark.createDataFrame([("ok",), ("failed",), (None,)], "status string")
    p = spark.createDataFrame([("ok", "x"), ("ok", "template"), ("failed", "x"), ("ok", None)], "status string, provider string")
    assert tuple(views.cache_counts(d, p).first()) == (1, 1) and tuple(views.cache_counts(d.limit(0), p.limit(0)).first()) == (0, 0)
    sheet = tables.rating_sheet(spark.createDataFrame([(1, "p", ["a", "b"], ["c"]), (2, "q", [], None)], "brief_id int, provider string, facts array<string>, hypotheses array<string>"))
    assert rows_of(sheet.select("brief_id", "kind", "claim", "rating"), "claim") == [(1, "fact", "a", None), (1, "fact", "b", None), (1, "hypothesis", "c", None)]


def test_results_beside_alerts(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "alert_id string, pos int")
    links = spark.createDataFrame([("A", "C1", "x")], "alert_id string, incident_id string, other string")
    scores = spark.createDataFrame([("A", 0.5, 0.6), ("B", 0.1, None)], "alert_id string, rule_score double, anomaly_score double")
    assert rows_of(tables.with_results(a, links, scores), "alert_id") == [("A", 1, "C1", 0.5, 0.6), ("B", 2, None, 0.1, None), ("C", 3, None, None, None)]


def test_contexts_truth_and_cache_files(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"users": {"Ann": {"privilege": 4, "baseline_hours": [8, 18], "known_src_ips": ["1.1.1.1"]}, "bob": {"privilege": 1}}}))
    (tmp_path / "a.json").write_text(json.dumps({"hosts": {"h1": {"ip": "10.0.0.1", "criticality": 3}, "h0": {"ip": "10.0.0.1"}, "h2": {}}, "resources": {"ERP": {"criticality": 5}}}))
    users, hosts, resources, at = readers.read_context(spark, str(tmp_path / "u.json"), str(tmp_path / "a.json"))
    assert rows_of(users.select("user", "privilege", "hours_from", "hours_to"), "user") == [("ann", 4, 8, 18), ("bob", 1, None, None)]
    assert rows_of(hosts.select("host", "criticality"), "host") == [("H0", None), ("H1", 3), ("H2", None)] and rows_of(resources.select("resource", "criticality"), "resource") == [("erp", 5)]
    assert rows_of(at.select("ip", "host"), "ip") == [("10.0.0.1", "H0")]  # of two hosts the smaller name
    (tmp_path / "t.json").write_text(json.dumps({"alerts": {"A": "G1", "B": None}, "incidents": {"G1": {"scenario": "s", "malicious": True, "priority": "high"}}}))
    truth, groups = readers.read_truth(spark, str(tmp_path / "t.json"))
    assert rows_of(truth, "alert_id") == [("A", "G1"), ("B", None)] and groups.first()["malicious"] is True
    (tmp_path / "c.json").write_text(json.dumps({"decisions": [{"evidence_hash": "e1", "model": "m", "status": "ok", "response": "{}"}], "briefs": []}))
    decisions, made = readers.read_cache(spark, str(tmp_path / "c.json"))
    assert decisions.first()["evidence_hash"] == "e1" and made.count() == 0
    tables.replace(spark.createDataFrame([("e1", "m", "failed", "x")], decisions.schema), str(tmp_path), "decision_runs")
    for _ in range(2):  # the cache goes in once, and out again without what failed
        tables.append_gaps(spark, str(tmp_path), "decision_runs", decisions, ["evidence_hash", "model"], only_ok=True)
    out = tables.exportable(tables.read(spark, str(tmp_path), "decision_runs"))
    tables.write_json(out, str(tmp_path / "out"))
    assert [r["response"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["{}"]


def test_own_rules_join_the_techniques(spark):
    """A rule from outside is one more table; of two rules for a technique the first wins, and ids that are not known go."""
    known = spark.createDataFrame([("T1", "one", ["a"]), ("T2", "two", ["b"])], "technique_id string, name string, tactics array<string>")
    kinds = "incident_id string, technique_id string, confidence double, evidence array<string>, reason string, rule int"
    own = spark.createDataFrame([("C", "T1", 0.4, ["A"], "later", 7), ("C", "T1", 0.9, ["B"], "first", 3), ("C", "T9", 0.9, ["B"], "unknown", 1), ("C", "T2", 0.95, [], "none", 9)], kinds)
    members = spark.createDataFrame([], "incident_id string, us long, pos long, alert_id string, alert_type string, user string, host string, src_ip string, src_ip_private boolean, process string, attributes string, vendor string")
    got = techniques.mapped(members, known, more=[own])
    assert rows_of(got.select("technique_id", "reason", "place"), "place") == [("T2", "none", 1), ("T1", "first", 2)]


@pytest.mark.parametrize("name", ["batch_log", "enriched_alerts"])
def test_new_queries_have_sql(name):
    from alertmill.plans import registry

    assert name in registry.QUERIES and name in registry.ORACLES
