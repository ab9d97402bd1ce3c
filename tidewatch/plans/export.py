"""Rules as query text: executable Spark SQL, and approximate EQL, SPL, KQL and ClickHouse SQL.

The four dialects have no exact form of a count within its own window or of a time-bound exception; their texts say so.
Literals are escaped.
"""

from __future__ import annotations

from tidewatch.functions.durations import SECOND, duration_text, micros
from tidewatch.functions.predicates import literals
from tidewatch.plans.rules import Count, Detection, Event, count_of, pattern_of

SYMBOLS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def quoted(value, mark: str) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    text = str(value)
    return f"'{text.replace(chr(39), chr(39) * 2)}'" if mark == "'" else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def condition(p, dialect: str) -> str:
    """One predicate; sql is ClickHouse's."""
    mark = "'" if dialect == "sql" else '"'
    name = p.field.replace(".", "_") if dialect in ("spl", "sql") else p.field
    say = lambda v: quoted(v, mark)
    many = ", ".join(say(v) for v in (sorted(p.value, key=str) if isinstance(p.value, set | frozenset) else literals(p.value)))
    same = {"eql": "==", "kql": "=="}.get(dialect, "=")
    other = "<>" if dialect == "sql" else "!="
    like = {"startswith": f"{p.value}*", "endswith": f"*{p.value}", "contains": f"*{p.value}*"}
    match p.op:
        case "eq":
            return f"{name} {same} {say(p.value)}"
        case "ne":
            return f"{name} {other} {say(p.value)}"
        case "in":
            return f"{name} in ({many})"
        case "not_in":
            return f"not {name} in ({many})"
        case "gt" | "gte" | "lt" | "lte":
            return f"{name} {SYMBOLS[p.op]} {say(p.value)}"
        case "startswith" | "endswith" | "contains":
            if dialect == "kql":
                return f"{name} {p.op} {say(p.value)}"
            if dialect == "sql":
                call = {"contains": "position", "startswith": "startsWith", "endswith": "endsWith"}[p.op]
                return f"{call}({name}, {say(p.value)})" + (" > 0" if p.op == "contains" else "")
            return f"{name} : {say(like[p.op])}" if dialect == "eql" else f"{name}={say(like[p.op])}"
        case "regex":
            return f"{name} matches regex {say(p.value)}" if dialect == "kql" else f"{name} regex {say(p.value)}" if dialect == "eql" else f"match({name}, {say(p.value)})"
        case "exists":
            if dialect == "kql":
                return f"isnotnull({name})" if p.value else f"isnull({name})"
            if dialect == "sql":
                return f"{name} IS {'NOT ' if p.value else ''}NULL"
            return f"{name} {'!=' if p.value else '=='} null"
    raise ValueError(p.op)


def conditions(e: Event, dialect: str) -> str:
    return " and ".join(condition(p, dialect) for p in e.predicates) or "true"


def eql(d: Detection) -> str:
    lines = [f"sequence by {', '.join(d.join_by)} with maxspan={duration_text(micros(d.sequence.within))}"]
    for s in d.sequence.steps:
        e = pattern_of(s)
        runs = f"  /* approximate: {s.at_least} or more within {duration_text(micros(s.within))} */" if isinstance(s, Count) else ""
        lines.append(f"  [{e.event_type} where {conditions(e, 'eql')}]{runs}")
    return "\n".join(lines + [f"until [{x.pattern.event_type} where {conditions(x.pattern, 'eql')}]" for x in d.exceptions])


def spl(d: Detection) -> str:
    keys = " ".join(k.replace(".", "_") for k in d.join_by)
    lines = ["`comment(\"approximate: order and sub-windows are not kept\")`", "index=events"]
    for i, s in enumerate(d.sequence.steps):
        e = pattern_of(s)
        lines.append(f"| eval step{i}=if(event_type={quoted(e.event_type, chr(34))} AND {conditions(e, 'spl').replace(' and ', ' AND ')}, 1, 0)")
    lines.append("| stats " + " ".join(f"sum(step{i}) as n{i}" for i in range(len(d.sequence.steps))) + f" earliest(_time) as first latest(_time) as last by {keys}")
    lines.append("| where " + " AND ".join(f"n{i} >= {count_of(s)}" for i, s in enumerate(d.sequence.steps)) + f" AND last - first <= {micros(d.sequence.within) // SECOND}")
    return "\n".join(lines + [f"| search NOT [search {x.pattern.event_type} {conditions(x.pattern, 'spl')}]" for x in d.exceptions])


def kql(d: Detection) -> str:
    lines = ["// approximate: order and sub-windows are not kept"]
    for i, s in enumerate(d.sequence.steps):
        e = pattern_of(s)
        lines.append(f"let step{i} = events | where event_type == {quoted(e.event_type, chr(34))} and {conditions(e, 'kql')} | summarize n{i} = count(), t{i} = min(event_time) by {', '.join(d.join_by)} | where n{i} >= {count_of(s)};")
    lines.append("step0" + "".join(f" | join kind=inner step{i} on {', '.join(d.join_by)}" for i in range(1, len(d.sequence.steps))))
    lines.append(f"| where t{len(d.sequence.steps) - 1} - t0 <= {duration_text(micros(d.sequence.within))}")
    return "\n".join(lines + [f"| join kind=leftanti (events | where event_type == {quoted(x.pattern.event_type, chr(34))} and {conditions(x.pattern, 'kql')}) on {', '.join(d.join_by)}" for x in d.exceptions])


def clickhouse(d: Detection) -> str:
    step = lambda e: f"event_type = {quoted(e.event_type, chr(39))} and {conditions(e, 'sql')}"
    keys = ", ".join(k.replace(".", "_") for k in d.join_by)
    steps = [pattern_of(s) for s in d.sequence.steps]
    having = [f"windowFunnel({micros(d.sequence.within) // SECOND})(event_time, {', '.join(step(e) for e in steps)}) = {len(steps)}"]
    having += [f"countIf({step(s.pattern)}) >= {s.at_least} /* within {duration_text(micros(s.within))} */" for s in d.sequence.steps if isinstance(s, Count)]
    having += [f"countIf({step(x.pattern)}) = 0" for x in d.exceptions]
    return f"-- approximate\nSELECT {keys}, min(event_time) AS started\nFROM events\nGROUP BY {keys}\nHAVING " + "\n   AND ".join(having)


def spark_sql(d: Detection, table: str = "steps") -> str:
    """Executable Spark SQL over a table (k0..., t, id, is0...) as operators.sequence.relevant makes it with flat positions:
    the groups in which the sequence fires, before exceptions."""
    keys = ", ".join(f"k{i}" for i in range(len(d.join_by)))
    ctes, before = [f"p AS (SELECT *, struct(t, id) AS pos FROM {table})"], "p"
    for i, s in enumerate(d.sequence.steps):
        after = f" AND coalesce(pos > e{i - 1}, false)" if i else ""
        ctes.append(f"f{i} AS (SELECT *, is{i}{after} AS c{i} FROM {before})")
        n = count_of(s)
        limit = micros(s.within) if isinstance(s, Count) else 0
        ctes.append(f"l{i} AS (SELECT *, lead(pos, {n - 1}) OVER (PARTITION BY {keys}, c{i} ORDER BY pos) AS z{i} FROM f{i})")
        ctes.append(f"m{i} AS (SELECT *, min(CASE WHEN c{i} AND z{i}.t - t <= {limit} THEN struct(pos AS s, z{i} AS e) END) OVER (PARTITION BY {keys}) AS b{i} FROM l{i})")
        ctes.append(f"s{i} AS (SELECT *, b{i}.s AS s{i}, b{i}.e AS e{i} FROM m{i})")
        before = f"s{i}"
    last = len(d.sequence.steps) - 1
    return f"WITH {', '.join(ctes)} SELECT DISTINCT {keys}, s0.t AS start_us, e{last}.t AS end_us FROM {before} WHERE e{last}.t - s0.t <= {micros(d.sequence.within)}"


DIALECTS = {"eql": eql, "spl": spl, "kql": kql, "clickhouse": clickhouse, "spark-sql": spark_sql}
