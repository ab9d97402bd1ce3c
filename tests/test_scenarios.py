import json

import pytest

from tidewatch import cli
from tidewatch.operators import investigate, lab
from tidewatch.operators.prepare import prepare
from tidewatch.plans import pack
from tidewatch.plans.rules import by_id
from tidewatch.plans.scenario import Scenario, builtin, case_file, percentile, replay
from tidewatch.sources.synthetic import background_noise, from_lab_actions, made_events


@pytest.fixture(scope="module")
def scenarios(spark):
    return builtin(spark)


def test_noise_is_the_same_on_every_run(spark):
    a, b = background_noise(spark, 400, 5), background_noise(spark, 400, 5).repartition(3)
    text = lambda df: sorted((r["event_id"], r["event_type"], r["event_us"], r["actor"]["user_id"], str(r["attributes"])) for r in df.collect())
    assert text(a) == text(b) and text(a) != text(background_noise(spark, 400, 6))
    assert {r["event_type"] for r in a.collect()} >= {"process.execution", "dns.query", "github.repository.clone"}


@pytest.mark.parametrize("name", ["departing_engineer", "compromised_developer", "privileged_admin"])
def test_scenario_opens_its_case(spark, scenarios, name):
    s = scenarios[name]
    report = replay(s, pack.DETECTIONS, with_durability=False)
    assert report.detections_triggered == s.expected["detections_triggered"] and len(report.cases) == s.expected["cases"]
    row = report.cases[0].row
    assert row["primary"] == s.expected["primary_hypothesis"] and row["risk"] >= 60
    assert f"Case opened: {row['case_number']}" in report.render()
    text = report.cases[0].render()
    assert all(x in text for x in s.facts["missing_evidence"]) and "Supporting evidence:" in text


def test_evidence_of_the_departing_engineer(spark, scenarios):
    s = scenarios["departing_engineer"]
    case = case_file(prepare(s.events), pack.COLLECTION, s.facts)
    assert case.of("supporting")[0].startswith("8 github.repository.clone events within 4m17s  [E1001")
    assert [x.split("  [")[0] for x in case.of("supporting")[1:]] == ["Encrypted archive created using gpg", "Data staged to removable_media", "Endpoint telemetry stopped", "First-ever access to restricted repositories", "New access token created shortly before activity", "Shell history deleted"]
    assert case.of("contradictory") == ["Activity originated from an enrolled corporate device", "User has legitimate engineering access"]
    assert case.of("missing")[0] == "No change management approval (would authorise this activity)" and len(case.of("missing")) == 4
    assert case.explanation[0].startswith("Step 1 — at least 8 github.repository.clone within 15m: satisfied by 8 events spanning 4m17s [E1001, ") and "SUPPRESSED" not in case.explanation[-1]
    assert case.row["thesis"] == "Malicious insider collection" and len(case.row["steps"]) == 11


def test_durability_and_regression(spark, scenarios):
    s = scenarios["departing_engineer"]
    holds = {r["probe"]: r["holds"] for r in lab.durability(prepare(s.events), pack.COLLECTION).collect()}
    assert not holds["missing field"] and holds["late events"] and holds["duplicates"]
    d = lab.rule_diff(s.events, pack.COLLECTION, pack._COLLECTION_V2)
    assert d.regression and "file_sensitivity" in d.cause and d.recommendation
    assert lab.count_step_fields(pack.COLLECTION) == ["repository_sensitivity", "access_is_first_seen"]


def test_authorised_activity_opens_no_case(spark, scenarios):
    s = scenarios["departing_engineer"]
    approval = made_events(spark, [("APPROVAL", "change_management.approval", 30, "servicenow", "jdoe", None, None, {"approval_status": "approved", "ticket": "CHG-1001"})])
    quiet = Scenario(s.id, s.events.unionByName(approval), detections=s.detections, facts=s.facts)
    assert replay(quiet, pack.DETECTIONS, with_durability=False).detections_triggered == 0


def test_save_and_load(spark, scenarios, tmp_path):
    s = scenarios["compromised_developer"]
    assert s.save(tmp_path / "s") == 512
    again = Scenario.load(spark, tmp_path / "s")
    assert (again.id, again.facts, again.expected) == (s.id, s.facts, s.expected)
    assert replay(again, pack.DETECTIONS, with_durability=False).case_ids == replay(s, pack.DETECTIONS, with_durability=False).case_ids


def test_own_hypotheses(spark, scenarios):
    s = scenarios["privileged_admin"]
    mine = (investigate.Hypothesis("X1", "Odd hours", True, 0.5, (("logging_disabled", 2.0, True, "logging off"), ("vacation", 1.0, False, "on vacation"))), investigate.Hypothesis("X2", "Drill"))
    case = case_file(prepare(s.events), pack.OFF_HOURS, {"vacation": True}, mine)
    assert case.row["primary"] == "X1" and case.of("contradictory") == ["On vacation"] and case.row["alternative"] == "X2"


def test_lab_actions(spark):
    rows = [(0, "clone", 10.0, "r", None, None, None), (1, "archive", 11.5, None, None, "tar c", None), (2, "other", 12.0, None, None, None, None), (3, "history_delete", 13.0, None, None, None, None)]
    got = from_lab_actions(spark.createDataFrame(rows, "line int, kind string, ts double, repo string, tool string, cmd string, path string")).orderBy("event_id").collect()
    assert [(r["event_id"], r["event_type"], r["event_us"]) for r in got] == [("LAB0000", "github.repository.clone", 10_000_000), ("LAB0001", "process.execution", 11_500_000), ("LAB0003", "filesystem.delete", 13_000_000)]
    assert "~/.bash_history" in str(got[2]["attributes"])


def test_percentile():
    assert percentile(list(range(150)), 0.99) == 148 and percentile([], 0.5) == 0 and percentile([3.0], 0.99) == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    rules = str(cli.Path(cli.__file__).parent / "plans" / "pack.py")
    for argv, said in (
        (["version"], "tidewatch"), (["rules", "list"], "TW-CC-0017@v1  [high]"), (["rules", "show", "--id", "TW-TT-0009"], "join by"), (["rules", "validate"], "no lint findings"),
        (["compile", rules, "--target", "spl", "--id", "TW-CC-0017"], "github.token.create"), (["replay", "privileged_admin", "--no-durability", "--explain"], "Competing hypothesis"), (["explain", rules, "privileged_admin", "--id", "TW-CC-0017"], "no case"),
        (["diff", rules, rules, "departing_engineer", "--id", "TW-IR-0042"], "no change in firing"),
    ):
        cli.main(argv)
        assert said in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["diff", rules, rules, "departing_engineer", "--id", "nope"])
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "scenario.json").write_text(json.dumps({"detections": ["none"]}))
    (tmp_path / "one" / "events.jsonl").write_text("")
    cli.main(["console", str(tmp_path / "out"), "--scenarios", str(tmp_path)])
    assert "TW-IR-0042" in (tmp_path / "out" / "index.html").read_text() and by_id(pack.DETECTIONS).keys() >= {"TW-IR-0042"}
