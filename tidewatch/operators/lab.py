"""Replay lab: mutations, durability, field coverage, rule differences."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import duration_text, micros
from tidewatch.functions.predicates import field as field_of
from tidewatch.operators.prepare import prepare
from tidewatch.operators.sequence import evaluate
from tidewatch.plans.rules import Count, Detection, pattern_of


def chance(seed: int) -> Column:
    """A number from 0 to 1 that depends on the event's id and the seed alone."""
    return F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def shuffled(events: DataFrame, seed: int = 0) -> DataFrame:
    """Another order of arrival."""
    return events.withColumn("observed_us", F.col("event_us") + F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(86_400_000_000)))


def duplicated(events: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    return events.union(events.where(chance(seed) < fraction))


def delayed(events: DataFrame, most: object = "10m", seed: int = 0) -> DataFrame:
    return events.withColumn("observed_us", F.col("event_us") + (chance(seed) * micros(most)).cast("bigint"))


def skewed(events: DataFrame, source: str, skew: object = "5m") -> DataFrame:
    """One source's clock runs ahead."""
    return events.withColumn("event_us", F.when(F.col("provenance.source") == source, F.col("event_us") + micros(skew)).otherwise(F.col("event_us")))


def reconnected(events: DataFrame, window: int = 6, seed: int = 0) -> DataFrame:
    """The first events are sent again."""
    return shuffled(events.union(events.orderBy("event_us", "event_id").limit(window)), seed)


def without_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") != event_type)


def without_field(events: DataFrame, name: str) -> DataFrame:
    return events.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != name))


def field_coverage(events: DataFrame, d: Detection) -> DataFrame:
    """event_type, field, coverage: the share of a step type's events in which a predicate's field is present."""
    wanted = sorted({(pattern_of(s).event_type, p.field) for s in d.sequence.steps for p in pattern_of(s).predicates})
    if not wanted:
        return events.sparkSession.createDataFrame([], "event_type string, field string, coverage double")
    counts = []
    for i, (kind, name) in enumerate(wanted):
        mine = F.col("event_type") == kind
        counts += [F.count_if(mine).alias(f"n{i}"), F.count_if(mine & F.coalesce(field_of(name).present, F.lit(False))).alias(f"p{i}")]
    one = events.where(F.col("event_type").isin([k for k, _ in wanted])).agg(*counts)
    rows = F.array(*[F.struct(F.lit(k).alias("event_type"), F.lit(n).alias("field"), F.when(F.col(f"n{i}") > 0, F.col(f"p{i}") / F.col(f"n{i}")).otherwise(0.0).alias("coverage")) for i, (k, n) in enumerate(wanted)])
    return one.select(F.inline(rows))


def dominant_source(events: DataFrame) -> DataFrame:
    """The source of most events, the last name among equals; 'unknown' without events."""
    counts = events.groupBy(F.col("provenance.source").alias("source")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max(F.struct("n", "source"))["source"], F.lit("unknown")).alias("source"))


def count_step_fields(d: Detection) -> list[str]:
    """Fields that a count step's predicates read: what a rule stops firing without."""
    return [p.field for s in d.sequence.steps if isinstance(s, Count) for p in s.pattern.predicates]


#: Mutations that apply to any stream, by name; more can be registered.
MUTATIONS = {"shuffle": shuffled, "duplicate": duplicated, "lateness": delayed, "reconnect": reconnected, "skew": skewed, "drop_type": without_type, "drop_field": without_field}


def mutate(events: DataFrame, *changes) -> DataFrame:
    """Mutations one after the other, each a name of MUTATIONS, or a name with a dict of arguments."""
    for change in changes:
        name, options = change if isinstance(change, tuple) else (change, {})
        events = MUTATIONS[name](events, **options)
    return events


PROBES = ("duplicates", "late events", "reordering", "reconnect", "clock skew", "missing type", "missing field")


def durability(events: DataFrame, d: Detection, missing_type: str = "dns.query", missing_field: str = "repository_sensitivity", source: str | None = None) -> DataFrame:
    """probe, cases, holds: whether the alerts of a mutated stream equal the plain stream's.

    All mutated streams are evaluated in one job: the probe is part of the join key. Without a baseline alert there are
    no rows.
    """
    source = source or dominant_source(events).first()["source"]
    streams = {
        "baseline": events, "reordering": shuffled(events, 7), "duplicates": duplicated(events, 0.3, 8), "late events": delayed(events, "12m", 9), "reconnect": reconnected(events),
        "clock skew": skewed(events, source), "missing type": without_type(events, missing_type), "missing field": without_field(events, missing_field),
    }
    tagged = reduce(DataFrame.unionByName, [s.withColumn("probe", F.lit(name)) for name, s in streams.items()])
    w = Window.partitionBy("probe", "event_id").orderBy("event_us")
    once = tagged.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    alerts = evaluate(once, d, ("probe",)).where("triggered")
    cases = alerts.groupBy("probe").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))
    base = cases.where("probe = 'baseline'").select(F.col("cases").alias("__base"))
    names = events.sparkSession.createDataFrame([(p,) for p in streams if p != "baseline"], "probe string")
    full = names.join(cases, "probe", "left").withColumn("cases", F.coalesce("cases", F.array().cast("array<string>")))
    return full.crossJoin(F.broadcast(base)).select("probe", F.size("cases").alias("cases"), (F.col("cases") == F.col("__base")).alias("holds"))


@dataclass
class RuleDiff:
    detection_id: str
    fired: tuple[bool, bool]
    support: tuple[int, int]
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    cause: str = ""

    @property
    def recommendation(self) -> str:
        """What to do about a regression; empty without one."""
        return f"Keep the older version, or make sure of what {', '.join(self.added) or 'the new version'} needs before it goes live." if self.regression else ""

    @property
    def regression(self) -> bool:
        return self.fired[0] and not self.fired[1]

    @property
    def improvement(self) -> bool:
        return self.fired[1] and not self.fired[0]

    def render(self) -> str:
        said = "regression" if self.regression else "improvement" if self.improvement else "no change in firing"
        return "\n".join([f"{self.detection_id}: {said}", f"  fired {self.fired[0]} -> {self.fired[1]}, events {self.support[0]} -> {self.support[1]}", *[f"  + {x}" for x in self.added], *[f"  - {x}" for x in self.removed], *([f"  cause: {self.cause}"] if self.cause else []), *([f"  {self.recommendation}"] if self.recommendation else [])])


def signature(d: Detection) -> dict[str, object]:
    return {f"{pattern_of(s).event_type}: {p.describe()}": p for s in d.sequence.steps for p in pattern_of(s).predicates} | {f"unless {x.describe()}": None for x in d.exceptions}


def rule_diff(events: DataFrame, old: Detection, new: Detection) -> RuleDiff:
    """How a rule's new version fares on the same events, with a likely cause if it stopped firing."""
    once = prepare(events)
    firsts = [evaluate(once, d).where("triggered").orderBy("start_us", "case_id").limit(1).select(F.size("steps").alias("n")).collect() for d in (old, new)]
    a, b = signature(old), signature(new)
    diff = RuleDiff(new.id, tuple(bool(f) for f in firsts), tuple(f[0]["n"] if f else 0 for f in firsts), sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys()))
    if diff.regression:
        added = {(k.split(": ")[0], b[k].field) for k in diff.added if b[k] is not None}
        poor = [r for r in field_coverage(events, new).collect() if (r["event_type"], r["field"]) in added and r["coverage"] < 1]
        steps = list(zip(old.sequence.steps, new.sequence.steps, strict=False))
        raised = [(s.at_least, t.at_least) for s, t in steps if isinstance(s, Count) and isinstance(t, Count) and t.at_least > s.at_least]
        if poor:
            worst = min(poor, key=lambda r: (r["coverage"], r["field"]))
            diff.cause = f"{worst['field']} is present in {worst['coverage']:.1%} of {worst['event_type']} events"
        elif raised:
            diff.cause = f"count threshold raised from {raised[0][0]} to {raised[0][1]}"
        elif micros(new.sequence.within) < micros(old.sequence.within):
            diff.cause = f"window narrowed from {duration_text(micros(old.sequence.within))} to {duration_text(micros(new.sequence.within))}"
        else:
            diff.cause = "stricter conditions"
    return diff
