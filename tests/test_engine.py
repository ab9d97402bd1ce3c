import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.durations import duration_text, micros
from tidewatch.functions.predicates import describe, predicate, split_keyword
from tidewatch.operators import identity, investigate, lab
from tidewatch.operators.components import connected_components
from tidewatch.operators.prepare import prepare
from tidewatch.operators.sequence import evaluate, match, match_any_start, relevant
from tidewatch.plans.export import DIALECTS, spark_sql
from tidewatch.plans.rules import Absence, Count, Detection, Event, Sequence, has_errors, lint, load_rules, tree
from tidewatch.sources.events import from_cloudtrail, from_github_audit, from_osquery, from_zeek_conn, iso_micros, normalise_json, rejects, to_json_lines
from tidewatch.streaming.admission import StreamingEvaluator, admission

BASE = "2026-02-02T22:00:00+00:00"
CASE = "ARI-" + hashlib.sha256(f"TW-0042|1|actor.user_id=jdoe;device.id=WS-1|{BASE}".encode()).hexdigest()[:10]
CLONE = Event("github.repository.clone").where(repository_sensitivity="restricted", access_is_first_seen=True)
COLLECT = Detection(
    "TW-0042", "Repository collection, then blinding", Sequence("45m", [Count(CLONE, 8, "15m"), Event("process.execution").where(process_name__in={"zip", "7z", "tar", "gpg"}), Event("filesystem.write").where(destination_type__in={"removable_media", "cloud_sync_folder"}), Event("security.telemetry_state").where(state__in={"stopped", "disabled", "degraded"})]),
    "critical", ("actor.user_id", "device.id"), [Absence(Event("change_management.approval").where(approval_status="approved"), "24h")],
)


def event(event_id, kind, minute, user="jdoe", device="WS-1", source="osquery", observed=None, **attributes):
    at = lambda m: f"2026-02-{2 + int((22 * 60 + m) // 1440):02d}T{int((22 * 60 + m) % 1440) // 60:02d}:{int((22 * 60 + m) % 60):02d}:{round((m % 1) * 60, 6):09.6f}Z"
    return {"event_id": event_id, "event_type": kind, "event_time": at(minute), "observed_time": None if observed is None else at(observed), "actor": {"user_id": user}, "device": {"id": device, "enrolled": True}, "provenance": {"source": source}, "attributes": attributes}


def chain(clones=10, gap=0.5, stop=20):
    out = [event(f"E{1000 + i}", "github.repository.clone", i * gap, source="github_audit", repository="r", repository_sensitivity="restricted", access_is_first_seen=True) for i in range(clones)]
    return out + [event("E2000", "process.execution", 16, process_name="gpg"), event("E2001", "filesystem.write", 18, destination_type="removable_media"), event("E2002", "security.telemetry_state", stop, state="stopped", telemetry_source="endpoint")]


def frame(spark, records):
    return normalise_json(spark.createDataFrame([(json.dumps(r),) for r in records], "value string"))


def fires(spark, records, d=COLLECT):
    return evaluate(prepare(frame(spark, records)), d).collect()


def test_durations():
    assert [micros(x) for x in ("45m", "1.5h", 2, "250ms")] == [2_700_000_000, 5_400_000_000, 2_000_000, 250_000]
    assert [duration_text(micros(x)) for x in ("7d", "90s", "24h", "36h", 0, 256.67, 0.25)] == ["1w", "1m30s", "1d", "36h", "0s", "4m17s", "0.25s"]
    with pytest.raises(ValueError):
        micros("soon")


def test_rule_text(tmp_path):
    assert split_keyword("a.b__gte") == ("a.b", "gte") and split_keyword("a__nope") == ("a__nope", "eq") and split_keyword("x__not_in") == ("x", "not_in")
    assert describe("a", "in", {"b", "a"}) == "a in {'a', 'b'}" and describe("a", "exists", False) == "a is absent" and describe("n", "gte", 5) == "n ≥ 5"
    assert "at least 8 within 15m" in tree(COLLECT) and not has_errors(lint(COLLECT))
    assert {f.code for f in lint(Detection("x", "x", Sequence(0, [Count(Event("a"), 1, "1m")]), "odd", ()))} == {"empty-window", "no-join", "count-window-too-wide", "unknown-severity"}
    with pytest.raises(ValueError):
        Sequence("1m", [])
    with pytest.raises(TypeError):
        Sequence("1m", [Absence(Event("a"))])
    with pytest.raises(ValueError):
        Count(Event("a"), 0)
    (tmp_path / "r.py").write_text("from tidewatch.plans.rules import *\nA = Detection('a', 'a', Sequence('1m', [Event('e')]))\nB = Detection('a', 'b', Sequence('1m', [Event('e')]))\n")
    assert [d.title for d in load_rules(tmp_path)] == ["a"]
    for name, export in DIALECTS.items():
        text = export(COLLECT)
        assert name == "spark-sql" or all(e.event_type in text for e in COLLECT.patterns()), name


def test_chain(spark):
    r = fires(spark, chain())
    assert len(r) == 1 and r[0]["triggered"] and r[0]["case_id"] == CASE
    assert [s["event_id"] for s in r[0]["steps"]] == [f"E{1000 + i}" for i in range(8)] + ["E2000", "E2001", "E2002"]
    assert not fires(spark, chain(clones=7)) and not fires(spark, chain(gap=5)) and not fires(spark, chain(stop=1))
    approval = event("A", "change_management.approval", -30, device="other", approval_status="approved")
    r = fires(spark, chain() + [approval])
    assert r[0]["suppressed_by"] == ["change_management.approval where approval_status = 'approved' within 1d"] and not r[0]["triggered"]
    assert fires(spark, chain() + [event("A", "change_management.approval", -30, user="else", approval_status="approved")])[0]["triggered"]
    mixed = [dict(r, actor={"user_id": "two"}) if i % 2 else r for i, r in enumerate(chain())]
    assert not fires(spark, mixed)
    shuffled = chain() + chain()[:5]
    random.Random(1).shuffle(shuffled)
    assert fires(spark, shuffled)[0]["case_id"] == CASE
    assert not fires(spark, [])


def two(within="45m", key=("actor.user_id",)):
    return Detection("T", "t", Sequence(within, [Event("A"), Event("B")]), join_by=key)


def test_edges(spark):
    late = [event("1", "A", 0), event("2", "A", 50), event("3", "B", 60)]
    assert not fires(spark, late, two())
    assert match_any_start(frame(spark, late), two()).count() == 1
    wide = Detection("T", "t", Sequence("45m", [Count(Event("A"), 2, "60m")]))
    assert not fires(spark, [event("1", "A", 0), event("2", "A", 50), event("3", "A", 60)], wide)
    assert fires(spark, [event("a", "A", 5), event("b", "B", 5)], two()) and not fires(spark, [event("b", "A", 5), event("a", "B", 5)], two())
    twice = Detection("T", "t", Sequence("9m", [Event("A"), Event("A")]))
    assert not fires(spark, [event("a", "A", 5)], twice) and fires(spark, [event("a", "A", 5), event("b", "A", 14)], twice) and not fires(spark, [event("a", "A", 5), event("b", "A", 14.01)], twice)
    assert len(fires(spark, [event("1", "A", 0, user=None), event("2", "B", 1, user=None), event("3", "A", 0), event("4", "B", 1)], two())) == 2
    anyone = Detection("T", "t", Sequence("45m", [Event("A"), Event("B")]), join_by=("device.id",), exceptions=[Absence(Event("X"), "24h")])
    pair = [event("1", "A", 0), event("2", "B", 1)]
    for minute, hit in ((-1440, True), (-1440.001, False), (1, True), (1.001, False)):
        assert fires(spark, pair + [event("3", "X", minute, user="other")], anyone)[0]["triggered"] != hit
    same = [event("10", "A", 5), event("9", "A", 5)]
    assert [r["event_id"] for r in prepare(frame(spark, same)).orderBy("event_us", "event_id").collect()] == ["10", "9"]


def greedy(events, steps, window):
    """One group, by a plain scan. events: (t, id, type) in order; steps: (type, count, window)."""
    at, first, used = 0, None, []
    for kind, n, w in steps:
        places = [i for i in range(at, len(events)) if events[i][2] == kind]
        hit = next((places[j : j + n] for j in range(len(places) - n + 1) if events[places[j + n - 1]][0] - events[places[j]][0] <= w), None)
        if not hit:
            return None
        first = events[hit[0]][0] if first is None else first
        if events[hit[-1]][0] > first + window:
            return None
        used += [events[i][1] for i in hit]
        at = hit[-1] + 1
    return used


def test_random_streams_equal_a_plain_scan(spark):
    rng = random.Random(9)
    minute = 60_000_000
    rules = [
        (Detection("R1", "", Sequence("30m", [Count(Event("A"), 3, "8m"), Event("B"), Event("C")])), [("A", 3, 8 * minute), ("B", 1, 0), ("C", 1, 0)], 30 * minute),
        (Detection("R2", "", Sequence("25m", [Event("A"), Count(Event("B"), 2, "5m"), Event("A")])), [("A", 1, 0), ("B", 2, 5 * minute), ("A", 1, 0)], 25 * minute),
        (Detection("R3", "", Sequence("20m", [Count(Event("A"), 2, "30m"), Count(Event("C"), 2, "6m")])), [("A", 2, 30 * minute), ("C", 2, 6 * minute)], 20 * minute),
    ]
    streams = {f"s{s}": sorted({(rng.randrange(40) * minute, f"{rng.randrange(1000):03d}", rng.choice("ABC")) for _ in range(rng.randrange(1, 25))}) for s in range(300)}
    rows = [(f"{i}", k, t, s) for s, events in streams.items() for t, i, k in events]
    df = frame(spark, [event("0", "none", 0)]).limit(1).drop("event_id", "event_type", "event_us", "actor").crossJoin(spark.createDataFrame(rows, "event_id string, event_type string, event_us long, user string"))
    df = df.withColumn("actor", F.expr("named_struct('user_id', user, 'principal_id', CAST(null AS STRING), 'username', CAST(null AS STRING), 'email', CAST(null AS STRING), 'source_identity', CAST(null AS STRING))"))
    for d, steps, window in rules:
        got = {r["k0"]: [s["event_id"] for s in r["steps"]] for r in match(df, d).collect()}
        want = {s: u for s, e in streams.items() if (u := greedy(e, steps, window)) is not None}
        assert got == want
        sql = spark.sql(spark_sql(d, "{t}"), t=relevant(df, d).select("k0", "pos.t", "pos.id", *[f"is{i}" for i in range(len(steps))]))
        assert {r["k0"] for r in sql.collect()} == set(want)


def test_predicates(spark):
    df = frame(spark, [event("1", "x", 0, **{"n": 5, "s": "5", "b": True, "l": ["a", 1], "a.b": None, "a": {"b": 7, "c": {"d": 2}}, "z": None})])
    yes = [("n", "eq", 5), ("s", "eq", "5"), ("b", "eq", 1), ("b", "eq", True), ("none", "ne", 1), ("none", "not_in", [1]), ("none", "eq", None), ("z", "eq", None), ("none", "in", [None, 2]), ("n", "gt", 4.5), ("l", "contains", "a"), ("l", "contains", 1), ("s", "contains", "5"), ("b", "startswith", "Tr"), ("a.c.d", "eq", 2), ("event_type", "regex", "(?P<q>x)"), ("actor.user_id", "eq", "jdoe"), ("device.enrolled", "eq", True), ("z", "exists", False), ("n", "in", 5), ("s", "in", "5")]
    no = [("n", "eq", "5"), ("s", "eq", 5), ("s", "gt", 4), ("n", "gt", "4"), ("none", "gt", 1), ("none", "in", [1]), ("none", "lte", 1), ("none", "contains", "x"), ("l", "contains", "b"), ("a.b", "eq", 7), ("a.b", "exists", True), ("none", "regex", "."), ("actor.nope", "exists", True), ("n", "not_in", [5])]
    row = df.select(*[predicate(*p).alias(f"y{i}") for i, p in enumerate(yes)], *[predicate(*p).alias(f"n{i}") for i, p in enumerate(no)]).first()
    assert all(row[f"y{i}"] is True for i in range(len(yes))), [p for i, p in enumerate(yes) if not row[f"y{i}"]]
    assert all(row[f"n{i}"] is False for i in range(len(no))), [p for i, p in enumerate(no) if row[f"n{i}"]]
    with pytest.raises(ValueError):
        predicate("a", "like", 1)


def test_records(spark):
    lines = [json.dumps({"event_id": "1", "event_type": "t", "event_time": "2026-01-01T00:00:00", "extra": 3, "both": 1, "attributes": {"both": 2}}), "not json", '{"event_id": "x"}', "  "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    r = normalise_json(df).select("event_us", "provenance.source", *[F.try_variant_get(F.col("attributes")[k], "$", "int").alias(k) for k in ("extra", "both")]).collect()
    assert [tuple(x) for x in r] == [(1767225600000000, "unknown", 3, 2)] and rejects(df).count() == 2
    again = normalise_json(to_json_lines(frame(spark, chain())))
    assert evaluate(again, COLLECT).first()["case_id"] == CASE
    assert spark.range(1).select(iso_micros(F.lit("2026-01-01T02:00:00+02:00"))).first()[0] == 1767225600000000


def test_adapters(spark):
    read = lambda kind, rows: spark.createDataFrame(rows, kind)
    o = from_osquery(read("eventid string, name string, unixTime string, hostIdentifier string, columns struct<name:string,path:string,username:string,uid:string,pid:string,parent:string,cmdline:string,cwd:string>", [(None, "procs", "1700000000", "h", (None, "/usr/bin/tar", "u", "501", "42", "1", "tar x", "/"))])).first()
    assert (o["event_id"], o["event_us"], o["actor"]["user_id"], o["device"]["os"]) == ("osq-1700000000-42", 1_700_000_000_000_000, "u", "linux")
    z = from_zeek_conn(read("ts double, uid string, `id.orig_h` string, `id.resp_h` string, `id.resp_p` int, orig_bytes long, resp_bytes long, proto string", [(1700000000.5, "C1", "10.0.0.1", "1.1.1.1", 443, 9, 8, "tcp")])).first()
    assert (z["event_id"], z["event_us"], z["device"]["ip"], z["actor"]["user_id"]) == ("C1", 1_700_000_000_500_000, "10.0.0.1", None)
    g = from_github_audit(read("action string, `@timestamp` long, actor string, actor_email string, repo string, repository_visibility string, token_name string, scopes string, _document_id string", [("git.clone", 1700000000000, "a", None, "r", None, None, None, None), ("org.x", 1, "a", None, "r", None, None, None, "d")])).collect()
    assert [(r["event_id"], r["event_type"]) for r in g] == [("gh-1700000000000-a", "github.repository.clone"), ("d", "github.org.x")]
    kind = "eventID string, eventName string, eventTime string, awsRegion string, userIdentity struct<userName:string,principalId:string,arn:string>, requestParameters struct<bucketName:string,key:string,userName:string>"
    c = from_cloudtrail(read(kind, [(None, "GetObject", "2026-01-01T00:00:00Z", "eu", (None, "p", "arn"), ("b", "k", None))])).first()
    assert (c["event_id"], c["event_type"], c["actor"]["user_id"], c["event_us"]) == ("ct-2026-01-01T00:00:00Z", "aws.s3.get_object", "p", 1767225600000000)


def test_admission_and_stream(spark, tmp_path):
    df = frame(spark, [event("1", "A", 0, observed=0), event("2", "A", 10, observed=10), event("3", "A", 5, observed=11), event("4", "A", 4.9999, observed=12), event("5", "A", 20, observed=13)])
    assert [r["late"] for r in admission(df, "5m").orderBy("event_id").collect()] == [False, False, False, True, False]
    assert [r["late"] for r in admission(df, "5m", slice_us=60_000_000).orderBy("event_id").collect()] == [False, False, False, True, False]
    records = [dict(r, observed_time=r["event_time"]) for r in chain()]
    for i, part in enumerate((records[:6], records[6:] + records[:2], [event("Q", "dns.query", -90, observed=60)])):
        target = StreamingEvaluator(spark, COLLECT, "30m", str(tmp_path / "admitted"))  # a new one, as after a restart
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        stream = normalise_json(spark.readStream.text(str(tmp_path / "in")))
        target.start(stream, str(tmp_path / "offsets")).awaitTermination()
    assert [r["case_id"] for r in target.result().collect()] == [CASE]
    assert [r["event_id"] for r in target.dropped_late().collect()] == ["Q"]


def test_lab(spark):
    df = prepare(frame(spark, chain() + [event("D", "dns.query", 1, source="zeek", query="x")]))
    holds = {r["probe"]: r["holds"] for r in lab.durability(df, COLLECT, source="zeek").collect()}
    assert not holds.pop("missing field") and all(holds.values()) and len(holds) == 6
    newer = Detection(COLLECT.id, "", Sequence("45m", [Count(Event("github.repository.clone").where(file_sensitivity="restricted"), 8, "15m"), *COLLECT.sequence.steps[1:]]), "critical", COLLECT.join_by, COLLECT.exceptions, "2")
    d = lab.rule_diff(df, COLLECT, newer)
    assert d.regression and d.support == (11, 0) and "file_sensitivity is present in 0.0%" in d.cause and "regression" in d.render()
    assert lab.rule_diff(df, newer, COLLECT).improvement


def test_case(spark):
    df = prepare(frame(spark, chain() + [event("Z", "network.connection", 25, source="zeek")]))
    c = investigate.cases(df, COLLECT).first()
    assert (c["primary"], c["confidence"], len(c["steps"]), c["case_number"]) == ("H1", "High", 11, "ARI-2026-3896") and c["risk"] >= 80 and "H1" in investigate.render_case(c)
    alerts = evaluate(df, COLLECT)
    used = investigate.decisive_evidence(alerts)
    again = df.join(used.select("event_id"), "event_id", "left_semi")
    assert evaluate(again, COLLECT).first()["case_id"] == c["case_id"]
    assert match(again.where("event_id <> 'E1003'"), COLLECT).isEmpty()
    lines = investigate.timeline(investigate.scoped_events(df, alerts)).collect()
    assert sum(r["is_gap"] for r in lines) == 1 and "selective blinding" in next(r["summary"] for r in lines if r["is_gap"])
    assert [r["events"] for r in investigate.explanation(alerts, COLLECT).orderBy("step").collect()] == [8, 1, 1, 1]


def test_exceptions_follow_the_steps(spark):
    alerts = evaluate(prepare(frame(spark, chain())), COLLECT)
    said = investigate.exception_lines(alerts, COLLECT).orderBy("step").collect()
    assert [r["step"] for r in said] == [4 + i for i in range(len(COLLECT.exceptions))] and said and all("no authorising event" in r["text"] for r in said)


def test_identity(spark):
    a = spark.createDataFrame([("github_user", "jdoe006", "g", 1.0), ("email", "m@acme.com", "g", 1.0), ("unix_uid", "501", "u", 0.94), ("aws_principal", "AROA", "a", 0.9), ("email", "alone@acme.com", "g", 0.5)], "type string, value string, source string, confidence double")
    links = [("github_user", "jdoe006", "email", "m@acme.com", 0.99, 1), ("email", "m@acme.com", "unix_uid", "501", 0.95, 2), ("email", "m@acme.com", "aws_principal", "AROA", 0.92, 3)]
    kind = "left_type string, left_value string, right_type string, right_value string, confidence double, seq int"
    got = {r["value"]: (r["principal_id"], round(r["confidence"], 6)) for r in identity.resolve(a, spark.createDataFrame(links, kind)).collect()}
    assert len({p for p, _ in got.values()}) == 2 and got["501"][1] == 0.88407 and got["alone@acme.com"][1] == 0.5
    with pytest.raises(ValueError):
        identity.resolve(a, spark.createDataFrame([("x", "y", "email", "m@acme.com", 0.5, 1)], kind))
    hops = spark.createDataFrame([("n", str(i), "s", 1.0 if i == 8 else 0.5) for i in range(1, 9)], "type string, value string, source string, confidence double")
    line = spark.createDataFrame([("n", str(i), "n", str(i + 1), 1.0, i) for i in range(1, 8)], kind)
    path = {r["value"]: r["confidence"] for r in identity.resolve(hops, line).collect()}
    assert path["1"] == 0 and path["2"] == 0.5
    row = spark.createDataFrame([(0.8,), (0.8,)], "c double").agg(identity.noisy_or("c").alias("n")).first()
    assert round(row["n"], 9) == 0.96


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(None, 5), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
