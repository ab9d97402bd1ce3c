"""Recorded incidents: events with a manifest, replayed through a rule pack."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import investigate, lab
from tidewatch.operators.prepare import prepare
from tidewatch.plans.rules import Detection
from tidewatch.sources import synthetic
from tidewatch.sources.events import read_jsonl, to_json_lines
from tidewatch.storage import stage

MANIFEST = ("id", "title", "description", "detections", "facts", "expected")


@dataclass
class Scenario:
    """Events and what frames them. Without detection ids every rule applies."""

    id: str
    events: DataFrame
    title: str = ""
    description: str = ""
    detections: list[str] = field(default_factory=list)
    facts: dict = field(default_factory=dict)
    expected: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, folder: str | Path) -> Scenario:
        """From scenario.json (any field may be missing) and events.jsonl, a file or a folder of part files."""
        at = Path(folder)
        manifest = json.loads((at / "scenario.json").read_text())
        named = {"id": at.name, "title": manifest.get("id", at.name)} | {k: manifest[k] for k in MANIFEST if k in manifest}
        return cls(events=read_jsonl(spark, str(at / "events.jsonl")), **named)

    def save(self, folder: str | Path) -> int:
        """Writes both; returns the number of events."""
        at = Path(folder)
        at.mkdir(parents=True, exist_ok=True)
        lines = stage(to_json_lines(self.events), "lines")
        lines.coalesce(1).write.mode("overwrite").text(str(at / "events.jsonl"))
        (at / "scenario.json").write_text(json.dumps({k: getattr(self, k) for k in MANIFEST}, indent=2))
        return lines.count()

    def applicable(self, rules: Iterable[Detection]) -> list[Detection]:
        return [d for d in rules if not self.detections or d.id in self.detections]


def builtin(spark: SparkSession) -> dict[str, Scenario]:
    """The three incidents that come with the library."""
    # Facts that no event shows, and what a replay has to find.
    made = {
        "departing_engineer": ("TW-IR-0042", "H1", {"legitimate_access": True, "contradictory": ["User has legitimate engineering access", "Activity originated from an enrolled corporate device"], "missing_evidence": ["Manager approval", "Change ticket", "DLP classification result"]}),
        "compromised_developer": ("TW-CC-0017", "H2", {"auth_from_unusual_infra": True, "no_endpoint_activity": True, "contradictory": ["Valid credentials were used (no brute force observed)"], "missing_evidence": ["Endpoint telemetry from the employee's enrolled device", "MFA challenge result"]}),
        "privileged_admin": ("TW-TT-0009", "H5", {"outside_maintenance_window": True, "unseen_device": True, "contradictory": ["Actor holds legitimate standing administrator privileges"], "missing_evidence": ["Approved maintenance ticket", "Break-glass justification record"]}),
    }
    return {
        name: Scenario(name.replace("_", "-"), getattr(synthetic, name)(spark), name.replace("_", " ").capitalize(), getattr(synthetic, name).__doc__, [rule], facts, {"cases": 1, "detections_triggered": 1, "primary_hypothesis": h})
        for name, (rule, h, facts) in made.items()
    }


@dataclass
class CaseFile:
    """One case, collected: its row, evidence, explanation and, where asked for, how it fared under mutation."""

    row: dict
    rule: Detection
    evidence: list[dict]
    explanation: list[str]
    durability: list[dict]

    def of(self, register: str) -> list[str]:
        return [x["text"] + (f"  [{', '.join(x['event_ids'])}]" if x["event_ids"] else "") for x in self.evidence if x["register"] == register]

    def render(self) -> str:
        r = self.row
        head = [f"CASE {r['case_number']}", f"Detection: {self.rule.pinned_id} — {self.rule.title}", f"Risk: {r['risk']} / 100", f"Confidence: {r['confidence']}", r["thesis"]]
        parts = [("Primary hypothesis", [f"{r['label']} (p={r['probability']:.2f})"]), ("Competing hypothesis", [r["alternative"]] if r["alternative"] else []), *[(f"{x.capitalize()} evidence", self.of(x)) for x in ("supporting", "contradictory", "missing")]]
        parts += [("Minimal decisive evidence", [", ".join(s["event_id"] for s in r["steps"])]), ("Detection durability", [f"{'passes' if x['holds'] else 'FAILS'}: {x['probe']}" for x in self.durability])]
        return "\n".join(head + [line for title, lines in parts if lines for line in ("", f"{title}:", *[f"  {x}" for x in lines])])


def case_file(events: DataFrame, d: Detection, facts: dict | None = None, hypotheses: tuple = investigate.DEFAULT, with_durability: bool = False) -> CaseFile | None:
    """The case of the rule's earliest alert on prepared events, or None. What is collected is one case."""
    found = investigate.investigate(events, d, facts, hypotheses, first_only=True)
    row = investigate.case_rows(found).first()
    if row is None:
        return None
    evidence = [x.asDict() for x in investigate.evidence(found).orderBy("register", "place").collect()]
    told = investigate.explanation(found.alerts, d).select("step", "text").union(investigate.exception_lines(found.alerts, d).select("step", "text"))
    said = [x["text"] for x in told.orderBy("step").collect()]
    probes = [x.asDict() for x in lab.durability(events, d).orderBy("probe").collect()] if with_durability else []
    return CaseFile(row.asDict(recursive=True), d, evidence, said, probes)


@dataclass
class ReplayReport:
    scenario_id: str
    events_processed: int
    detections_triggered: int
    behavior_chains_matched: int
    cases: list[CaseFile]
    latency_seconds: float

    @property
    def case_ids(self) -> list[str]:
        return [c.row["case_number"] for c in self.cases]

    def render(self) -> str:
        counted = [f"Scenario: {self.scenario_id}", f"Events processed: {self.events_processed:,}", f"Detections triggered: {self.detections_triggered}", f"Behavior chains matched: {self.behavior_chains_matched}"]
        return "\n".join([*counted, *[f"Case opened: {x}" for x in self.case_ids], f"Detection latency: {self.latency_seconds:.2f} seconds"])


def replay(scenario: Scenario, rules: Iterable[Detection], with_durability: bool = True, hypotheses: tuple = investigate.DEFAULT) -> ReplayReport:
    """Evaluates the applicable rules over the scenario's events in one pass, and opens a case for each that fires."""
    from tidewatch.operators.sequence import evaluate_pack

    events = stage(prepare(scenario.events), "events")
    rules, began = scenario.applicable(rules), time.monotonic()
    counts = {}
    if rules:
        found = evaluate_pack(events, rules).where("triggered").groupBy("detection_id", "version").agg(F.count("*").alias("n"))
        counts = {(r["detection_id"], r["version"]): r["n"] for r in found.collect()}
    fired = [d for d in rules if (d.id, d.version) in counts]
    files = [case_file(events, d, scenario.facts, hypotheses, with_durability) for d in fired]
    took = time.monotonic() - began
    return ReplayReport(scenario.id, events.count(), len(fired), sum(counts.values()), sorted((c for c in files if c), key=lambda c: c.row["case_number"]), took)


def percentile(samples: list[float], share: float) -> float:
    """The sample at the nearest rank: of n sorted ones that at floor(share * n), the last at most."""
    ordered = sorted(samples)
    return ordered[min(len(ordered) - 1, int(share * len(ordered)))] if ordered else 0.0
