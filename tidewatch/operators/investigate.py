"""From alerts to cases: actor scope, signals, hypotheses, risk, evidence, timeline."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import duration_column, duration_text, micros
from tidewatch.functions.predicates import field, predicate
from tidewatch.operators.sequence import ACTOR, evaluate
from tidewatch.plans.rules import Count, Detection, pattern_of
from tidewatch.storage import stage

# Event types and values that signals look for.
ARCHIVERS = ("zip", "7z", "tar", "gpg", "rar", "openssl")
REMOVABLE = ("removable_media", "cloud_sync_folder", "usb")
STOPPED = ("stopped", "disabled", "degraded")
ENDPOINT = ("endpoint", "osquery", "edr")
TOKEN_TYPES = ("github.token.create", "identity.token.create")
OBJECT_TYPES = ("aws.s3.get_object", "cloud.object.retrieve")
CREATE_TYPES = ("iam.user.create", "identity.principal.create")
DELETE_TYPES = ("iam.user.delete", "identity.principal.delete")
LIVE_SOURCES = ("zeek", "network", "cloudtrail", "github_audit", "okta")
SEVERITY_WEIGHTS = {"critical": 100, "high": 85, "medium": 65, "low": 40, "info": 20}

# Hypotheses as (id, label, malicious, prior) and their indicators as (signal, weight, supports).
HYPOTHESES = (
    ("H1", "Malicious insider collection", True, 0.0),
    ("H2", "Compromised developer credentials", True, 0.0),
    ("H3", "Authorized migration", False, 0.0),
    ("H4", "Security-team testing", False, -0.5),
    ("H5", "Privileged administrator abuse", True, 0.0),
    ("H6", "Broken automation", False, -1.0),
)
INDICATORS = {
    "H1": (("bulk_restricted_clone", 1.4, True), ("first_seen_access", 0.8, True), ("archive_created", 0.9, True), ("removable_media_write", 1.1, True), ("endpoint_telemetry_stopped", 1.0, True), ("shell_history_deleted", 0.7, True), ("device_enrolled", 0.6, True), ("approval_present", 1.6, False), ("no_endpoint_activity", 1.2, False)),
    "H2": (("new_token_created", 1.0, True), ("auth_from_unusual_infra", 1.4, True), ("no_endpoint_activity", 1.5, True), ("cloud_object_retrieval", 0.8, True), ("removable_media_write", 1.0, False), ("device_enrolled", 0.7, False)),
    "H3": (("approval_present", 2.2, True), ("legitimate_access", 1.0, True), ("device_enrolled", 0.6, True), ("endpoint_telemetry_stopped", 1.2, False), ("shell_history_deleted", 1.0, False)),
    "H4": (("security_team_actor", 1.8, True), ("approval_present", 0.6, True)),
    "H5": (("logging_disabled", 1.2, True), ("outside_maintenance_window", 1.3, True), ("unseen_device", 1.1, True), ("temp_identity_created", 1.0, True), ("temp_identity_deleted", 0.8, True), ("approval_present", 1.4, False)),
    "H6": (("automation_actor", 1.6, True), ("shell_history_deleted", 1.0, False), ("removable_media_write", 1.0, False)),
}
# How contradicting indicators read in a case, by hypothesis and signal.
NOTES = {
    ("H1", "approval_present"): "approved change ticket", ("H1", "no_endpoint_activity"): "no endpoint activity on device",
    ("H2", "removable_media_write"): "local removable-media staging", ("H2", "device_enrolled"): "activity from enrolled device",
    ("H3", "endpoint_telemetry_stopped"): "telemetry stopped", ("H3", "shell_history_deleted"): "shell history deleted",
    ("H5", "approval_present"): "approved maintenance ticket",
    ("H6", "shell_history_deleted"): "interactive shell history deleted", ("H6", "removable_media_write"): "removable-media staging",
}
# Sentences of cases.
THESES = {"H2": "More consistent with compromised credentials than deliberate insider activity", "H5": "Anomalous privileged-administrator activity outside the approved maintenance window"}
ENROLLED = "Activity originated from an enrolled corporate device"
STEP_TEXTS = {"process.execution": ("process_name", "Encrypted archive created using ", "archive tool"), "filesystem.write": ("destination_type", "Data staged to ", "external destination"), "security.telemetry_state": ("state", "Endpoint telemetry ", "altered")}
SIGNAL_TEXTS = (("first_seen_access", "First-ever access to restricted repositories"), ("new_token_created", "New access token created shortly before activity"), ("shell_history_deleted", "Shell history deleted"))


@dataclass(frozen=True)
class Hypothesis:
    """An explanation; indicators are (signal, weight, whether it supports, note)."""

    id: str
    label: str
    malicious: bool = False
    prior: float = 0.0
    indicators: tuple[tuple[str, float, bool, str], ...] = ()


DEFAULT = tuple(Hypothesis(h, label, bad, prior, tuple((s, w, up, NOTES.get((h, s), s.replace("_", " "))) for s, w, up in INDICATORS[h])) for h, label, bad, prior in HYPOTHESES)


def scoped_events(events: DataFrame, alerts: DataFrame, by_actor: bool = True) -> DataFrame:
    """Events of each alert's actor, with case_id; all events for an alert without one (or a rule not joined on it).

    The alerts are written out once. Only where some alert takes in all events does a join without a key take place, and
    its result is that product.
    """
    small = alerts.select("case_id", F.col("actor_id").alias("__actor") if by_actor else F.lit(None).cast("string").alias("__actor"), F.transform("steps", lambda s: s["event_id"]).alias("__used"))
    small = stage(small, "alerts")
    same = events.join(small.where("__actor IS NOT NULL"), F.col(ACTOR) == F.col("__actor"))
    wide = small.where("__actor IS NULL")
    return same if wide.isEmpty() else same.unionByName(events.join(wide, F.lit(True)))


def signals(scoped: DataFrame) -> DataFrame:
    """case_id and a boolean for each signal that events show."""
    kind = F.col("event_type")
    used = F.array_contains("__used", F.col("event_id"))
    clone = kind == "github.repository.clone"
    restricted = clone & predicate("repository_sensitivity", "eq", "restricted")
    stop = (kind == "security.telemetry_state") & predicate("state", "in", STOPPED)
    endpoint = stop & F.coalesce(field("telemetry_source").text, F.lit("endpoint")).isin(*ENDPOINT)
    seen = field("access_is_first_seen")
    truthy = F.coalesce(seen.number != 0, F.length(seen.string) > 0, F.lit(False))
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return scoped.groupBy("case_id").agg(
        ((F.count_if(restricted) >= 5) | any_of(clone & used)).alias("bulk_restricted_clone"),
        any_of(clone & truthy).alias("first_seen_access"),
        any_of((kind == "process.execution") & predicate("process_name", "in", ARCHIVERS)).alias("archive_created"),
        any_of((kind == "filesystem.write") & predicate("destination_type", "in", REMOVABLE)).alias("removable_media_write"),
        any_of(endpoint).alias("endpoint_telemetry_stopped"),
        any_of(stop).alias("logging_disabled"),
        any_of(kind.isin("filesystem.delete", "shell.history.clear") & F.coalesce(field("path").text, kind).contains("history")).alias("shell_history_deleted"),
        any_of(kind.isin(*TOKEN_TYPES)).alias("new_token_created"),
        any_of(kind.isin(*OBJECT_TYPES) | kind.contains("GetObject")).alias("cloud_object_retrieval"),
        any_of(kind.isin(*CREATE_TYPES)).alias("temp_identity_created"),
        any_of(kind.isin(*DELETE_TYPES)).alias("temp_identity_deleted"),
        any_of(used & F.col("device.enrolled")).alias("device_enrolled"),
    )


def with_facts(found: DataFrame, facts: dict | None, hypotheses: tuple = DEFAULT) -> DataFrame:
    """Facts override signals; signals that nothing shows are false."""
    facts = facts or {}
    for s in sorted({s for h in hypotheses for s, *_ in h.indicators} | {x for x, v in facts.items() if isinstance(v, bool)}):
        if s in facts:
            found = found.withColumn(s, F.lit(bool(facts[s])))
        elif s not in found.columns:
            found = found.withColumn(s, F.lit(False))
    return found


def hypothesis_scores(found: DataFrame, hypotheses: tuple = DEFAULT) -> DataFrame:
    """case_id, hypothesis, label, malicious, score, support, against (notes), probability (softmax over a case), rank."""
    rows = []
    for h in hypotheses:
        plus = reduce(lambda a, b: a + b, [F.col(s).cast("double") * w for s, w, up, _ in h.indicators if up], F.lit(0.0))
        minus = reduce(lambda a, b: a + b, [F.col(s).cast("double") * w for s, w, up, _ in h.indicators if not up], F.lit(0.0))
        notes = F.array(*[F.when(F.col(s), F.lit(note)) for s, _, up, note in h.indicators if not up]).cast("array<string>")
        against = F.filter(notes, lambda n: n.isNotNull()).alias("against")
        rows.append(F.struct(F.lit(h.id).alias("hypothesis"), F.lit(h.label).alias("label"), F.lit(h.malicious).alias("malicious"), (F.lit(float(h.prior)) + plus - minus).alias("score"), plus.alias("support"), against))
    flat = found.select("case_id", F.inline(F.array(*rows)))
    w = Window.partitionBy("case_id")
    weighed = flat.withColumn("__e", F.exp(F.col("score") - F.max("score").over(w)))
    scored = weighed.withColumn("probability", F.col("__e") / F.sum("__e").over(w)).drop("__e")
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("probability"), "hypothesis")))


def risk(severity: str, probability: Column, malicious: Column) -> Column:
    """Rounded half to even."""
    raw = F.lit(float(SEVERITY_WEIGHTS.get(severity, 65))) * probability * F.when(malicious, 1.0).otherwise(0.25)
    return F.bround(raw).cast("long")


def confidence(probability: Column) -> Column:
    return F.when(probability >= 0.85, "High").when(probability >= 0.6, "Medium").otherwise("Low")


def case_number(year: int) -> Column:
    """ARI-year- and the first four digits of the case id, filled with zeros."""
    return F.concat(F.lit(f"ARI-{year}-"), F.rpad(F.substring(F.regexp_replace("case_id", "[^0-9]", ""), 1, 4), 4, "0"))


def thesis(hypothesis: Column, label: Column, malicious: Column) -> Column:
    said = F.create_map(*[F.lit(x) for kv in THESES.items() for x in kv])[hypothesis]
    return F.coalesce(said, F.when(malicious, label).otherwise(F.concat(F.lit("Most consistent with: "), label)))


@dataclass
class Investigation:
    """What was found of a rule's alerts: tables with a case_id each, written out."""

    detection: Detection
    alerts: DataFrame
    scoped: DataFrame
    signals: DataFrame
    scores: DataFrame
    facts: dict

    @property
    def primary(self) -> DataFrame:
        return self.scores.where("rank = 1").select("case_id", F.col("hypothesis").alias("primary"), "label", "malicious", "probability", "against")


def investigate(events: DataFrame, d: Detection, facts: dict | None = None, hypotheses: tuple = DEFAULT, first_only: bool = False) -> Investigation:
    """Evaluates the rule on prepared events once, and scores the hypotheses for each alert, or the earliest only."""
    alerts = stage(evaluate(events, d).where("triggered"), "alerts")
    if first_only:
        alerts = stage(alerts.orderBy("start_us", "case_id").limit(1), "alerts")
    scoped = scoped_events(events, alerts, ACTOR in d.join_by)
    shown = stage(with_facts(signals(scoped), facts, hypotheses), "signals")
    return Investigation(d, alerts, scoped, shown, stage(hypothesis_scores(shown, hypotheses), "scores"), facts or {})


def cases(events: DataFrame, d: Detection, facts: dict | None = None, year: int = 2026, hypotheses: tuple = DEFAULT) -> DataFrame:
    """One row an alert: ids, the first hypothesis and the leading alternative of the other kind, risk, confidence."""
    return case_rows(investigate(events, d, facts, hypotheses), year)


def case_rows(found: Investigation, year: int = 2026) -> DataFrame:
    d, scores, first = found.detection, found.scores, found.primary
    rest = scores.where("rank > 1").alias("r").join(first.alias("f"), "case_id")
    other = F.col("r.malicious") != F.col("f.malicious")
    # the opposite kind with the most support; the runner-up where no such hypothesis has any
    lead = rest.groupBy("case_id").agg(F.max(F.struct(other.alias("o"), F.when(other, F.col("support")).otherwise(0.0).alias("s"), F.col("r.probability").alias("p"), F.col("r.hypothesis").alias("h")))["h"].alias("alternative"))
    joined = found.alerts.join(first, "case_id").join(lead, "case_id", "left")
    return joined.select(
        case_number(year).alias("case_number"), "case_id", F.lit(d.id).alias("detection_id"), "primary", "label", "alternative", "probability", thesis(F.col("primary"), F.col("label"), F.col("malicious")).alias("thesis"),
        risk(d.severity, F.col("probability"), F.col("malicious")).alias("risk"), confidence(F.col("probability")).alias("confidence"), "start_us", "end_us", "steps",
    )


def _sentences(rows: DataFrame, register: str, place: Column, text: Column, ids: Column | None = None) -> DataFrame:
    return rows.select("case_id", F.lit(register).alias("register"), place.cast("int").alias("place"), text.alias("text"), (F.array().cast("array<string>") if ids is None else ids).alias("event_ids"))


def supporting(found: Investigation) -> DataFrame:
    """What made the rule fire: a sentence for each step with its events, then for signals that single events show."""
    steps = found.detection.sequence.steps
    flat = found.alerts.select("case_id", F.explode("steps").alias("s")).select("case_id", "s.step", "s.event_us", "s.event_id")
    attributes = sorted({STEP_TEXTS[pattern_of(s).event_type][0] for s in steps if not isinstance(s, Count) and pattern_of(s).event_type in STEP_TEXTS})
    shown = found.scoped.where(F.array_contains("__used", F.col("event_id"))).select("case_id", "event_id", *[field(a).text.alias(f"__{a}") for a in attributes])
    per_step = flat.join(shown, ["case_id", "event_id"], "left").groupBy("case_id", "step").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_us", "event_id"))), lambda x: x["event_id"]).alias("ids"), F.count("*").alias("n"), (F.max("event_us") - F.min("event_us")).alias("span"), *[F.first(f"__{a}").alias(f"__{a}") for a in attributes]
    )
    text = F.lit(None).cast("string")
    for i, s in enumerate(steps):
        kind = pattern_of(s).event_type
        if isinstance(s, Count):
            said = F.concat(F.col("n").cast("string"), F.lit(f" {kind} events within "), duration_column(F.col("span")))
        elif kind in STEP_TEXTS:
            attribute, begin, lacking = STEP_TEXTS[kind]
            said = F.concat(F.lit(begin), F.coalesce(f"__{attribute}", F.lit(lacking)))
        else:
            said = F.lit(pattern_of(s).describe())
        text = F.when(F.col("step") == i, said).otherwise(text)
    parts = [_sentences(per_step, "supporting", F.col("step"), text, F.col("ids"))]
    kind, seen = F.col("event_type"), field("access_is_first_seen")
    which = {
        "first_seen_access": (kind == "github.repository.clone") & F.coalesce(seen.number != 0, F.length(seen.string) > 0, F.lit(False)),
        "new_token_created": kind.isin(*TOKEN_TYPES),
        "shell_history_deleted": kind.isin("filesystem.delete", "shell.history.clear") & F.coalesce(field("path").text, kind).contains("history"),
    }
    for n, (signal, said) in enumerate(SIGNAL_TEXTS):
        mine = found.scoped.where(which[signal]).join(found.signals.where(F.col(signal)).select("case_id"), "case_id", "left_semi")
        ids = mine.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_us", "event_id"))), lambda x: x["event_id"]).alias("ids"))
        parts.append(_sentences(ids, "supporting", F.lit(1000 + n), F.lit(said), F.col("ids")))
    return reduce(DataFrame.unionByName, parts)


def contradictory(found: Investigation) -> DataFrame:
    """What speaks against the first hypothesis: its own notes, the enrolled device, facts; equal texts once, the first."""
    given = F.array(*[F.lit(x) for x in found.facts.get("contradictory", [])]).cast("array<string>")
    notes = F.transform("against", lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 1000))))
    every = F.concat(notes, F.when(F.col("device_enrolled"), F.array(F.lit(ENROLLED))).otherwise(F.array().cast("array<string>")), given)
    rows = found.primary.join(found.signals.select("case_id", "device_enrolled"), "case_id").select("case_id", F.posexplode(every).alias("place", "text"))
    first = rows.groupBy("case_id", F.lower(F.trim("text")).alias("same")).agg(F.min(F.struct("place", "text")).alias("t"))
    return _sentences(first, "contradictory", F.col("t.place"), F.col("t.text"))


def missing(found: Investigation) -> DataFrame:
    """What would settle the question: authorising events that weren't found, and facts."""
    says = [(x.describe(), f"No {x.pattern.event_type.replace('.', ' ').replace('_', ' ')} (would authorise this activity)") for x in found.detection.exceptions]
    looked = F.array(*[F.when(~F.array_contains("suppressed_by", F.lit(d)), F.lit(t)) for d, t in says]).cast("array<string>")
    given = F.array(*[F.lit(x) for x in found.facts.get("missing_evidence", [])]).cast("array<string>")
    rows = found.alerts.select("case_id", F.posexplode(F.concat(F.filter(looked, lambda x: x.isNotNull()), given)).alias("place", "text"))
    return _sentences(rows, "missing", F.col("place"), F.col("text"))


def neutral(found: Investigation, text: str) -> DataFrame:
    """A fact that leans neither way, for every case."""
    return _sentences(found.alerts, "neutral", F.lit(0), F.lit(text))


def evidence(found: Investigation) -> DataFrame:
    """case_id, register (supporting, contradictory, missing), place, text, event_ids."""
    return supporting(found).unionByName(contradictory(found)).unionByName(missing(found))


def decisive_evidence(alerts: DataFrame) -> DataFrame:
    """case_id, event_id, event_us: the smallest set that fires, which is the contributing events."""
    return alerts.select("case_id", F.explode("steps").alias("s")).select("case_id", "s.event_us", "s.event_id")


def explanation(alerts: DataFrame, d: Detection) -> DataFrame:
    """case_id, step, events, span_us, text of every step that fired, its conditions below it."""
    flat = alerts.select("case_id", F.explode("steps").alias("s"))
    spans = flat.groupBy("case_id", F.col("s.step").alias("step")).agg(F.count("*").alias("events"), (F.max("s.event_us") - F.min("s.event_us")).alias("span_us"), F.transform(F.array_sort(F.collect_list(F.struct("s.event_us", "s.event_id"))), lambda x: x["event_id"]).alias("ids"))
    listed = F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]"))
    text = F.lit(None).cast("string")
    for i, s in enumerate(d.sequence.steps):
        kind = pattern_of(s)
        if isinstance(s, Count):
            head = F.lit(f"Step {i + 1} — at least {s.at_least} {kind.event_type} within {duration_text(micros(s.within))}: satisfied by ")
            said = F.concat(head, F.col("events").cast("string"), F.lit(" events spanning "), duration_column(F.col("span_us")), F.lit(" "), listed, *[F.lit(f"\n    · {p.describe()}") for p in kind.predicates])
        else:
            said = F.concat(F.lit(f"Step {i + 1} — {kind.describe()}: matched by "), listed)
        text = F.when(F.col("step") == i, said).otherwise(text)
    return spans.select("case_id", "step", "events", "span_us", text.alias("text"))


def exception_lines(alerts: DataFrame, d: Detection) -> DataFrame:
    """case_id, step, text of every exception; their steps follow on those of the sequence."""
    out = alerts.select("case_id", F.lit(0).alias("step"), F.lit("").alias("text")).limit(0)
    for i, x in enumerate(d.exceptions):
        found = F.array_contains("suppressed_by", F.lit(x.describe()))
        verdict = F.when(found, "an authorising event was found, so the detection was SUPPRESSED").otherwise("no authorising event within window, so the negative condition holds")
        said = F.concat(F.lit(f"Exception — no {x.describe()}: "), verdict)
        out = out.unionByName(alerts.select("case_id", F.lit(len(d.sequence.steps) + i).alias("step"), said.alias("text")))
    return out


def summary() -> Column:
    """A line of text for an event on a timeline."""
    text = lambda p: F.coalesce(field(p).text, F.lit("?"))
    kind = F.col("event_type")
    return (
        F.when(kind == "github.repository.clone", F.concat(F.lit("clone "), F.coalesce(field("repository").text, field("repository_name").text, F.lit("?")), F.lit(" (sensitivity="), text("repository_sensitivity"), F.lit(")")))
        .when(kind == "process.execution", F.concat(F.lit("process "), text("process_name")))
        .when(kind == "filesystem.write", F.trim(F.concat(F.lit("write to "), text("destination_type"), F.lit(" "), F.coalesce(field("path").text, F.lit("")))))
        .when(kind == "security.telemetry_state", F.concat(F.lit("telemetry "), text("state"), F.lit(" ("), text("source"), F.lit(")")))
        .when(kind == "github.token.create", F.lit("GitHub access token created"))
        .when((kind == "filesystem.delete") & F.coalesce(field("path").text.contains("history"), F.lit(False)), F.concat(F.lit("shell history deleted ("), text("path"), F.lit(")")))
        .otherwise(kind)
    )


def telemetry_gaps(scoped: DataFrame) -> DataFrame:
    """case_id, event_id, event_us, summary of stops after which another source stayed live.

    One pass over a case from its end: every row knows the next live event, and the next after it that reports for
    another source, so a stop has its survivor without meeting the case's other events.
    """
    stop = (F.col("event_type") == "security.telemetry_state") & predicate("state", "in", STOPPED)
    live = F.coalesce(F.col("provenance.source").isin(*LIVE_SOURCES), F.lit(False))
    named = F.coalesce(field("telemetry_source").text, F.lit("endpoint"))
    rows = scoped.where(stop | live).select("case_id", "event_us", "event_id", stop.alias("stop"), named.alias("stopped"), F.when(live, F.struct(F.col("provenance.source").alias("source"), field("telemetry_source").text.alias("reports"))).alias("live"))
    back = Window.partitionBy("case_id").orderBy(F.desc("event_us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("next", F.last("live", ignorenulls=True).over(back))
    turns = F.col("live").isNotNull() & ~F.col("live.reports").eqNullSafe(F.col("next.reports"))
    seen = seen.withColumn("turn", F.when(turns | (F.col("live").isNotNull() & F.col("next").isNull()), F.struct(F.col("next").alias("then"))))
    seen = seen.withColumn("other", F.last("turn", ignorenulls=True).over(back)["then"])
    survivor = F.when(~F.col("next.reports").eqNullSafe(F.col("stopped")), F.col("next.source")).otherwise(F.col("other.source"))
    found = seen.where("stop AND next IS NOT NULL").withColumn("survivor", survivor).where("survivor IS NOT NULL")
    return found.select("case_id", "event_id", "event_us", F.concat("stopped", F.lit(" telemetry stopped while "), "survivor", F.lit(" stayed live — selective blinding")).alias("summary"))


def timeline(scoped: DataFrame) -> DataFrame:
    """case_id, event_us, is_gap, event_id, event_type, summary in order."""
    rows = scoped.select("case_id", "event_us", F.lit(False).alias("is_gap"), "event_id", "event_type", summary().alias("summary"))
    blind = telemetry_gaps(scoped).select("case_id", "event_us", F.lit(True).alias("is_gap"), "event_id", F.lit("telemetry.gap").alias("event_type"), "summary")
    return rows.unionByName(blind).orderBy("case_id", "event_us", "is_gap", "event_id")


def render_timeline(rows: list) -> str:
    """Collected timeline rows as text, a line each."""
    from datetime import UTC, datetime, timedelta

    at = lambda us: (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).isoformat()
    return "\n".join(f"{at(r['event_us'])}{'  ⚠ ' if r['is_gap'] else '    '}{r['summary']}  [{r['event_id']}]" for r in rows)


def render_case(row) -> str:
    """A case row as text."""
    return "\n".join([f"{row['case_number']}  {row['detection_id']}  risk {row['risk']}  confidence {row['confidence']}", f"  {row['primary']} {row['label']} ({row['probability']:.1%}); alternative {row['alternative']}", f"  {len(row['steps'])} decisive events"])


def seal(evidence: DataFrame, data: str, by: str, at: Column) -> DataFrame:
    """Adds sha256, size_bytes and a custody list with one entry."""
    entry = F.struct(F.lit(by).alias("actor"), F.lit("acquired").alias("action"), at.cast("timestamp").alias("at"), F.lit(None).cast("string").alias("note"))
    return evidence.withColumn("sha256", F.sha2(F.col(data).cast("binary"), 256)).withColumn("size_bytes", F.octet_length(F.col(data).cast("binary"))).withColumn("custody", F.array(entry))


def verify(evidence: DataFrame, data: str) -> DataFrame:
    return evidence.withColumn("intact", F.sha2(F.col(data).cast("binary"), 256) == F.col("sha256"))


def transfer(evidence: DataFrame, actor: str, action: str, at: Column, note: str | None = None) -> DataFrame:
    entry = F.struct(F.lit(actor).alias("actor"), F.lit(action).alias("action"), at.cast("timestamp").alias("at"), F.lit(note).cast("string").alias("note"))
    return evidence.withColumn("custody", F.array_append("custody", entry))

