"""Ordered sequence matching as chained window aggregates over one shuffle.

Positions are (event time, event id). Each join group takes the earliest admissible first step and from there the
earliest next one, once: a group has one match or none. Steps' positions rise strictly, so the overall window is
tested once, on the last. Only events that meet a step enter the shuffle, and exceptions meet the few matches in one order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import micros
from tidewatch.functions.predicates import key_column
from tidewatch.plans.rules import Count, Detection, Event, count_of, pattern_of
from tidewatch.sources.events import iso_text
from tidewatch.storage import stage

ACTOR = "actor.user_id"
SLICE_US = 24 * 3600 * 1_000_000


def keys_of(d: Detection) -> list[str]:
    return [f"k{i}" for i in range(len(d.join_by))]


class Flags:
    """Every different pattern of the rules' steps and exceptions, with the name of its flag."""

    def __init__(self, rules: list[Detection]):
        self.patterns = {self.mark(p): p for d in rules for p in d.patterns()}
        self.names = {m: f"is_{i}" for i, m in enumerate(self.patterns)}

    @staticmethod
    def mark(pattern: Event) -> tuple:
        return pattern.event_type, tuple((p.field, p.op, repr(p.value)) for p in pattern.predicates)

    def of(self, pattern: Event) -> Column:
        return F.col(self.names[self.mark(pattern)])

    def columns(self) -> list[Column]:
        return [p.column().alias(self.names[m]) for m, p in self.patterns.items()]


def any_of(flags) -> Column:
    return reduce(lambda x, y: x | y, flags)


def flagged(events: DataFrame, rules: list[Detection], extra: tuple = ()) -> DataFrame:
    """What rules need of events, each predicate evaluated once: extra..., event_us, event_id, actor_id, a column for each
    key path and a flag for each pattern. Only types that the rules name, and events that meet a pattern, are left."""
    flags = Flags(rules)
    types = sorted({p.event_type for p in flags.patterns.values()})
    keys = [key_column(p).alias(c) for p, c in key_paths(rules).items()]
    rows = events.where(F.col("event_type").isin(types)).select(*extra, "event_us", "event_id", F.col(ACTOR).alias("actor_id"), *keys, *flags.columns())
    return rows.where(any_of(F.col(c) for c in flags.names.values()))


def key_paths(rules: list[Detection]) -> dict[str, str]:
    return {p: f"key_{i}" for i, p in enumerate(dict.fromkeys(p for d in rules for p in d.join_by))}


def relevant(events: DataFrame, d: Detection, extra: tuple = ()) -> DataFrame:
    """Events that meet a step of the rule, with its keys, a position and a flag for each step."""
    return steps_of(flagged(events, [d], extra), [d], d, extra)


def steps_of(rows: DataFrame, rules: list[Detection], d: Detection, extra: tuple = ()) -> DataFrame:
    """relevant() of one rule, from the flagged events of several."""
    named, paths = Flags(rules), key_paths(rules)
    own = [named.of(pattern_of(s)) for s in d.sequence.steps]
    flags = [f.alias(f"is{i}") for i, f in enumerate(own)]
    keys = [F.col(paths[p]).alias(k) for p, k in zip(d.join_by, keys_of(d), strict=True)]
    return rows.where(any_of(own)).select(*extra, *keys, "actor_id", F.struct(F.col("event_us").alias("t"), F.col("event_id").alias("id")).alias("pos"), *flags)


def step_positions(rows: DataFrame, d: Detection, keys: list[str]) -> DataFrame:
    """rows with s{i} and e{i}, the first and last position of each step's events in the group. Groups leave at the first
    step that finds none; those without enough events of each step don't enter the first."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    least = [F.count_if(F.col(f"is{i}")).over(w) >= count_of(step) for i, step in enumerate(d.sequence.steps)]
    rows = rows.withColumn("__able", reduce(lambda x, y: x & y, least)).where("__able").drop("__able")
    for i, step in enumerate(d.sequence.steps):
        flag = F.col(f"is{i}")
        if i:
            flag = F.coalesce(flag & (F.col("pos") > F.col(f"e{i - 1}")), F.lit(False))
        if isinstance(step, Count) and step.at_least > 1:
            rows = rows.withColumn(f"c{i}", flag)
            slices = Window.partitionBy(*(keys or [F.lit(0)]), f"c{i}").orderBy("pos")
            rows = rows.withColumn("__last", F.lead("pos", step.at_least - 1).over(slices))
            fits = F.col(f"c{i}") & (F.col("__last.t") - F.col("pos.t") <= micros(step.within))
            rows = rows.withColumn("__best", F.min(F.when(fits, F.struct(F.col("pos").alias("s"), F.col("__last").alias("e")))).over(w))
            rows = rows.withColumn(f"s{i}", F.col("__best.s")).withColumn(f"e{i}", F.col("__best.e")).drop("__last", "__best")
        else:
            rows = rows.withColumn(f"c{i}", flag).withColumn(f"s{i}", F.min(F.when(flag, F.col("pos"))).over(w)).withColumn(f"e{i}", F.col(f"s{i}"))
        rows = rows.where(F.col(f"e{i}").isNotNull())
    return rows


def match(events: DataFrame, d: Detection, extra: tuple = ()) -> DataFrame:
    """One row for each group that the sequence fires in, before exceptions.

    Columns: extra..., k0..., actor_id, start_us, end_us, steps (array of (step, event_us, event_id) in order).
    `extra` names columns of events that are part of the key, a variant of the stream for instance. A null key is a
    group of its own.
    """
    return match_steps(relevant(events, d, extra), d, extra)


def match_steps(rows: DataFrame, d: Detection, extra: tuple = ()) -> DataFrame:
    """match() of what relevant() gives."""
    keys = [*extra, *keys_of(d)]
    rows = rows.repartition(*keys) if keys else rows
    placed = step_positions(rows, d, keys)
    last = len(d.sequence.steps) - 1
    fired = placed.where(F.col(f"e{last}").isNotNull() & (F.col(f"e{last}.t") - F.col("s0.t") <= micros(d.sequence.within)))
    used = [F.when(F.col(f"c{i}") & F.col("pos").between(F.col(f"s{i}"), F.col(f"e{i}")), F.struct(F.lit(i).alias("step"), F.col("pos.t").alias("event_us"), F.col("pos.id").alias("event_id"))) for i in range(last + 1)]
    chosen = fired.withColumn("used", F.coalesce(*used)).where("used IS NOT NULL")
    first_actor = F.min(F.struct("pos", "actor_id"))["actor_id"]
    out = chosen.groupBy(*keys) if keys else chosen.groupBy()
    out = out.agg(first_actor.alias("actor_id"), F.min("s0.t").alias("start_us"), F.max(f"e{last}.t").alias("end_us"), F.array_sort(F.collect_list("used")).alias("steps"))
    return out.where("start_us IS NOT NULL")


def case_id(d: Detection) -> Column:
    """ARI- and ten digits of a hash over rule, version, keys and start."""
    shown = [F.concat(F.lit(f"{p}="), F.coalesce(F.col(k), F.lit("None"))) for p, k in zip(d.join_by, keys_of(d), strict=True)]
    text = F.concat_ws("|", F.lit(d.id), F.lit(d.version), F.concat_ws(";", *shown), iso_text(F.col("start_us")))
    return F.concat(F.lit("ARI-"), F.substring(F.sha2(text, 256), 1, 10))


def suppressions(found: DataFrame, x: DataFrame, d: Detection, extra: tuple = ()) -> DataFrame:
    """found with suppressed_by. x: extra..., x_actor, x_us and a flag x{n} for each exception.

    An exception counts if the last one until the match's end is not before its start less the time allowed, so no pair
    is ever formed: matches and exceptions lie in one order, and a running maximum passes over it. An actor's exceptions
    are a partition; where anyone's count they are parted by time, with the maxima of earlier parts carried over.
    """
    n = len(d.exceptions)
    none = [F.lit(None).cast("bigint").alias(f"__x{i}") for i in range(n)]
    mine = F.col("actor_id") if ACTOR in d.join_by else F.lit(None).cast("string")
    kept = [F.col(c) for c in found.columns if c not in extra]
    matches = found.select(*extra, F.struct(*kept).alias("__match"), mine.alias("__scope"), F.col("end_us").alias("__t"), *none)
    times = [F.when(F.col(f"x{i}"), F.col("x_us")).alias(f"__x{i}") for i in range(n)]
    rest = [F.lit(None).cast(matches.schema["__match"].dataType).alias("__match")]
    everyone = x.select(*extra, *rest, F.lit(None).cast("string").alias("__scope"), F.col("x_us").alias("__t"), *times)
    rows = matches.union(everyone)
    if ACTOR in d.join_by:
        rows = rows.union(x.where("x_actor IS NOT NULL").select(*extra, *rest, F.col("x_actor").alias("__scope"), F.col("x_us").alias("__t"), *times))
    part = F.when(F.col("__scope").isNull(), F.floor(F.col("__t") / SLICE_US))
    last = Window.partitionBy(*extra, "__scope", "__part").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ran = rows.withColumn("__part", part).withColumns({f"__l{i}": F.max(f"__x{i}").over(last) for i in range(n)}).where("__match IS NOT NULL")
    tops = everyone.withColumn("__part", part).groupBy(*extra, "__part").agg(*[F.max(f"__x{i}").alias(f"__m{i}") for i in range(n)])
    # parts without an exception have no row here, so a match looks for the last part before its own
    order = Window.partitionBy(*extra).orderBy("__part", "__late")
    waiting = ran.where("__scope IS NULL").select(*extra, "__part").distinct().select("*", F.lit(0).alias("__late"), *[F.lit(None).cast("bigint").alias(f"__m{i}") for i in range(n)])
    carried = waiting.union(tops.select(*extra, "__part", F.lit(1).alias("__late"), *[f"__m{i}" for i in range(n)]))
    carried = carried.withColumns({f"__c{i}": F.max(f"__m{i}").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for i in range(n)}).where("__late = 0")
    named = carried.select(*[F.col(c).alias(f"__e_{c}") for c in extra], F.col("__part").alias("__p"), *[f"__c{i}" for i in range(n)])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in extra], F.col("__part") == F.col("__p"))
    full = ran.join(named, same, "left")
    hit = [F.greatest(f"__l{i}", f"__c{i}") >= F.col("__match.start_us") - micros(e.within) for i, e in enumerate(d.exceptions)]
    reasons = F.filter(F.array(*[F.when(h, F.lit(e.describe())) for h, e in zip(hit, d.exceptions, strict=True)]), lambda r: r.isNotNull())
    return full.select(*extra, "__match.*", reasons.alias("suppressed_by"))


def evaluate(events: DataFrame, d: Detection, extra: tuple = ()) -> DataFrame:
    """Matches with case_id, suppressed_by (descriptions of the exceptions found, in the rule's order) and triggered.

    Events are taken as prepared. An exception counts from its `within` before the start until the end, both included;
    only the same actor's counts if the rule is joined on the actor and the match has one, else anyone's.
    """
    return evaluate_flagged(flagged(events, [d], extra), [d], d, extra)


def evaluate_flagged(rows: DataFrame, rules: list[Detection], d: Detection, extra: tuple = ()) -> DataFrame:
    """evaluate() of one rule, from the flagged events of several."""
    found = match_steps(steps_of(rows, rules, d, extra), d, extra).withColumn("case_id", case_id(d))
    if d.exceptions:
        own = [Flags(rules).of(x.pattern) for x in d.exceptions]
        x = rows.where(any_of(own)).select(*extra, F.col("actor_id").alias("x_actor"), F.col("event_us").alias("x_us"), *[f.alias(f"x{i}") for i, f in enumerate(own)])
        found = suppressions(found, x, d, extra)
    else:
        found = found.withColumn("suppressed_by", F.array().cast("array<string>"))
    return found.withColumn("triggered", F.size("suppressed_by") == 0)


def evaluate_pack(events: DataFrame, rules: list[Detection]) -> DataFrame:
    """The matches of several rules: detection_id, version, case_id, start_us, end_us, triggered, suppressed_by, steps.

    Events are read, prepared and tested once for all rules; what a rule reads is the flagged events, a few narrow columns.
    """
    kept = ["case_id", "start_us", "end_us", "triggered", "suppressed_by", "steps"]
    rows = stage(flagged(events, rules), "flagged") if len(rules) > 1 else flagged(events, rules)
    parts = [evaluate_flagged(rows, rules, d).select(F.lit(d.id).alias("detection_id"), F.lit(d.version).alias("version"), *kept) for d in rules]
    return reduce(DataFrame.unionByName, parts)


def join_groups(events: DataFrame, d: Detection) -> DataFrame:
    """How many events each join group holds."""
    return events.select(*[key_column(p).alias(k) for p, k in zip(d.join_by, keys_of(d), strict=True)]).groupBy(*keys_of(d)).agg(F.count("*").alias("events"))


def match_any_start(events: DataFrame, d: Detection) -> DataFrame:
    """Beyond the reference: groups where some choice of the first event completes the chain (event steps after the first
    may start from every admissible first step). One row for each group, the earliest completing start."""
    keys = keys_of(d)
    rows = relevant(events, d).repartition(*keys)
    first = d.sequence.steps[0]
    n = count_of(first)
    slices = Window.partitionBy(*keys, "is0").orderBy("pos")
    starts = rows.withColumn("__last", F.lead("pos", n - 1).over(slices) if n > 1 else F.col("pos"))
    limit = micros(first.within) if isinstance(first, Count) else 0
    begun = F.when(F.col("is0") & (F.col("__last.t") - F.col("pos.t") <= limit), F.struct(F.col("pos").alias("s"), F.col("__last").alias("e")))
    # The latest start whose slice has ended before a row is the best one for a chain through that row.
    ended = starts.withColumn("__begun", begun)
    done = ended.where("__begun IS NOT NULL").select(*keys, F.col("__begun.e").alias("pos"), F.col("__begun.s").alias("best0"), *[F.lit(False).alias(f"is{i}") for i in range(len(d.sequence.steps))])
    chain = ended.select(*keys, "pos", F.lit(None).cast(done.schema["best0"].dataType).alias("best0"), *[f"is{i}" for i in range(len(d.sequence.steps))]).unionByName(done)
    order = Window.partitionBy(*keys).orderBy("pos", F.col("best0").isNotNull())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = F.max("best0").over(before)
    for i in range(1, len(d.sequence.steps)):
        chain = chain.withColumn(f"best{i}", F.when(F.col(f"is{i}"), state))
        state = F.max(f"best{i}").over(before)
    last = f"best{len(d.sequence.steps) - 1}"
    done = chain.where(F.col(last).isNotNull() & (F.col("pos.t") - F.col(f"{last}.t") <= micros(d.sequence.within)))
    return done.groupBy(*keys).agg(F.min(F.col(f"{last}.t")).alias("start_us"))
