"""Queries over the driver's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import micros
from tidewatch.functions.predicates import predicate
from tidewatch.operators import identity, investigate, lab
from tidewatch.operators.components import connected_components
from tidewatch.operators.prepare import first_seen, prepare
from tidewatch.operators.sequence import evaluate, evaluate_pack, join_groups, keys_of, match, match_any_start, relevant
from tidewatch.plans.export import spark_sql
from tidewatch.plans.rules import Absence, Count, Detection, Event, Sequence
from tidewatch.sources.events import from_cloudtrail, from_github_audit, from_osquery, from_zeek_conn, iso_text, micros_of, normalise_json, rejects, struct_of, table_events, variants
from tidewatch.streaming.admission import admission, first_arrivals, lateness_seconds

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ERRORS = Count(Event("error"), 3, "48h")
CHAIN = Sequence("5d", [ERRORS, Event("signup"), Event("purchase")])
FLAGSHIP = Detection("TW-0001", "Errors, then a signup, then a purchase", CHAIN, "high")
GUARDED = Detection("TW-0002", "The same, unless a dear view came with it", CHAIN, "critical", exceptions=[Absence(Event("view").where(value__gte=120), "24h")])
BY_DEVICE = Detection("TW-0003", "A chain on one device", Sequence("2d", [Event("error"), Event("signup"), Event("purchase")]), join_by=("device.id",), exceptions=[Absence(Event("view").where(value__gte=120), "1m")])
TWO_KEYS = Detection("TW-0004", "A user's chain on one device", CHAIN, join_by=("actor.user_id", "device.id"))
LATER_COUNT = Detection("TW-0005", "A signup, then clicks, then a purchase", Sequence("6d", [Event("signup"), Count(Event("click"), 3, "36h"), Event("purchase")]))
NULL_KEY = Detection("TW-0006", "Keyed by an attribute that is often missing", Sequence("2d", [Event("error"), Event("purchase").where(value__gt=50)]), join_by=("hi_k",))
TIGHT = Detection("TW-0001", "Four errors", Sequence("5d", [Count(Event("error").where(hi_k__gte=50), 4, "48h"), Event("signup"), Event("purchase")]), version="2")

#: The events table as table_events() makes it.
EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS n, event_type, epoch_us(ts) AS t, epoch_us(ts) + (event_id * 7919 % 600) * 1000000 AS observed_us,
  CAST(user_id AS VARCHAR) AS user_id, 'd' || CAST(event_id % 3 AS VARCHAR) AS device_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type IN ('purchase', 'signup') THEN 'app' ELSE 'monitor' END AS source,
  value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS hi_k FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chain_sql(steps: list[tuple[str, int, int]], keys: str, within: int, source: str = "ev", t: str = "t") -> str:
    """CTEs for greedy matching; steps are (condition, count, window); ends with fired(keys, start_us, end_us) and the
    positions of every step in the last f."""
    flags = ", ".join(f"({c}) AS is{i}" for i, (c, _, _) in enumerate(steps))
    out = [f"p AS (SELECT *, {t} AS tt, row_number() OVER (ORDER BY {t}, event_id) AS pos, {flags} FROM {source})"]
    before = "p"
    for i, (_, n, w) in enumerate(steps):
        after = f" AND coalesce(pos > e{i - 1}, false)" if i else ""
        out.append(f"a{i} AS (SELECT *, (is{i}{after}) AS c{i} FROM {before})")
        out.append(f"b{i} AS (SELECT *, lead(pos, {n - 1}) OVER x AS z{i}, lead(tt, {n - 1}) OVER x AS y{i} FROM a{i} WINDOW x AS (PARTITION BY {keys}, c{i} ORDER BY pos))")
        out.append(f"d{i} AS (SELECT *, min(CASE WHEN c{i} AND y{i} - tt <= {w} THEN pos END) OVER (PARTITION BY {keys}) AS s{i} FROM b{i})")
        out.append(f"f{i} AS (SELECT *, min(CASE WHEN pos = s{i} THEN z{i} END) OVER x AS e{i}, min(CASE WHEN pos = s{i} THEN tt END) OVER x AS st{i}, min(CASE WHEN pos = s{i} THEN y{i} END) OVER x AS et{i} FROM d{i} WINDOW x AS (PARTITION BY {keys}))")
        before = f"f{i}"
    last = len(steps) - 1
    out.append(f"fired AS (SELECT DISTINCT {keys}, st0 AS start_us, et{last} AS end_us FROM {before} WHERE et{last} - st0 <= {within})")
    used = ", ".join(f"WHEN c{i} AND pos BETWEEN s{i} AND e{i} THEN {i}" for i in range(last + 1)).replace(", WHEN", " WHEN")
    out.append(f"used AS (SELECT *, CASE {used} END AS step FROM {before} WHERE et{last} - st0 <= {within})")
    return ", ".join(out)


D2, D5, D6, H36, H48 = micros("2d"), micros("5d"), micros("6d"), micros("36h"), micros("48h")
CHAIN_STEPS = [("event_type = 'error'", 3, H48), ("event_type = 'signup'", 1, 0), ("event_type = 'purchase'", 1, 0)]
CHAIN_SQL = f"{EV}, {chain_sql(CHAIN_STEPS, 'user_id', D5)}"
ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({0} % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"


def case_sql(d: Detection, keys: list[str], start: str = "start_us") -> str:
    shown = " || ';' || ".join(f"'{p}=' || coalesce({k}, 'None')" for p, k in zip(d.join_by, keys, strict=True))
    return f"'ARI-' || substr(sha256('{d.id}|{d.version}|' || {shown} || '|' || {ISO.format(start)}), 1, 10)"


@query(f"WITH {EV} SELECT event_id, event_type, t AS event_us, observed_us, user_id, device_id, source, value, k, hi_k FROM ev")
def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda k, t: F.try_variant_get(F.col("attributes")[k], "$", t)
    e = table_events(spark, sf_dir)
    return e.select("event_id", "event_type", "event_us", "observed_us", "actor.user_id", F.col("device.id").alias("device_id"), "provenance.source", get("value", "double").alias("value"), get("k", "bigint").alias("k"), get("hi_k", "bigint").alias("hi_k"))


@query(f"WITH {EV}, u AS (SELECT event_id, t FROM ev UNION ALL SELECT event_id, t + (n % 5 - 2) * 60000000 FROM ev WHERE n % 3 = 0) SELECT event_id, min(t) AS event_us FROM u GROUP BY event_id")
def dedup_event_id(spark, sf_dir):
    e = table_events(spark, sf_dir)
    n = F.col("event_id").cast("bigint")
    copies = e.where(n % 3 == 0).withColumn("event_us", F.col("event_us") + (n % 5 - 2) * 60_000_000)
    return prepare(e.unionByName(copies)).select("event_id", "event_us")


@query(f"WITH {EV}, u AS (SELECT event_id, n, t FROM ev UNION ALL SELECT 'c' || event_id, n, t FROM ev WHERE n % 3 = 0 UNION ALL SELECT '!' || event_id, n, t FROM ev WHERE n % 4 = 0) SELECT min(event_id) AS event_id, min(t) AS event_us FROM u GROUP BY n")
def dedup_fingerprint(spark, sf_dir):
    e = table_events(spark, sf_dir)
    n = F.col("event_id").cast("bigint")
    more = [e.where(n % m == 0).withColumn("event_id", F.concat(F.lit(c), "event_id")).withColumn("observed_us", F.lit(0).cast("bigint")) for m, c in ((3, "c"), (4, "!"))]
    return prepare(e.unionByName(more[0]).unionByName(more[1]), "fingerprint").select("event_id", "event_us")


PREDICATES = {
    "eq": ("hi_k", 60, "hi_k IS NOT DISTINCT FROM 60"),
    "ne": ("hi_k", 60, "hi_k IS DISTINCT FROM 60"),
    "in": ("hi_k", [50, 60.0, "70"], "coalesce(hi_k IN (50, 60), false)"),
    "not_in": ("hi_k", (50, 60), "coalesce(hi_k NOT IN (50, 60), true)"),
    "gt": ("value", 100, "value > 100"),
    "gte": ("hi_k", 80, "coalesce(hi_k >= 80, false)"),
    "lt": ("hi_k", 80, "coalesce(hi_k < 80, false)"),
    "lte": ("value", 20.5, "value <= 20.5"),
    "startswith": ("name", ("pur", "cl"), "event_type LIKE 'pur%' OR event_type LIKE 'cl%'"),
    "endswith": ("name", "up", "event_type LIKE '%up'"),
    "contains": ("name", "ic", "contains(event_type, 'ic')"),
    "regex": ("name", "^(view|err)", "regexp_matches(event_type, '^(view|err)')"),
    "exists": ("hi_k", True, "hi_k IS NOT NULL"),
}


def _predicate_query(op, path, value):
    return lambda spark, sf_dir: table_events(spark, sf_dir).where(predicate(path, op, value)).select("event_id")


for _op, (_path, _value, _sql) in PREDICATES.items():
    QUERIES[f"pred_{_op}"] = _predicate_query(_op, _path, _value)
    ORACLE_SQL[f"pred_{_op}"] = f"WITH {EV} SELECT event_id FROM ev WHERE {_sql}"


@query(f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'view' AND coalesce(value >= 120, false) AND hi_k IS DISTINCT FROM 60")
def event_match(spark, sf_dir):
    return table_events(spark, sf_dir).where(Event("view").where(value__gte=120).where(hi_k__ne=60).column()).select("event_id")


@query(f"WITH {EV} SELECT user_id AS k0, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY user_id")
def join_groups_by_user(spark, sf_dir):
    return join_groups(table_events(spark, sf_dir), FLAGSHIP)


def flat(found: DataFrame, d: Detection) -> DataFrame:
    return found.select(*keys_of(d), "start_us", "end_us")


ONE_COUNT = Detection("TW-0010", "Errors", Sequence("48h", [ERRORS]))
FIRST_ERROR = Detection("TW-0011", "An error, then a signup", Sequence("30d", [Event("error"), Event("signup")]))


@query(f"WITH {EV}, {chain_sql(CHAIN_STEPS[:1], 'user_id', H48)} SELECT user_id AS k0, start_us, end_us FROM fired")
def count_step(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), ONE_COUNT), ONE_COUNT)


@query(f"WITH {EV}, e AS (SELECT user_id, min(t) AS a FROM ev WHERE event_type = 'error' GROUP BY user_id), s AS (SELECT e.user_id, a, min(t) AS b FROM e JOIN ev ON ev.user_id = e.user_id AND event_type = 'signup' AND t > a GROUP BY ALL) SELECT user_id AS k0, a AS start_us, b AS end_us FROM s WHERE b - a <= {micros('30d')}")
def event_step_first(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), FIRST_ERROR), FIRST_ERROR)


@query(f"WITH {CHAIN_SQL} SELECT user_id AS k0, start_us, end_us FROM fired")
def sequence_match(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), FLAGSHIP), FLAGSHIP)


@query(f"WITH {EV}, {chain_sql(CHAIN_STEPS, 'user_id, device_id', D5)} SELECT user_id AS k0, device_id AS k1, start_us, end_us FROM fired")
def sequence_two_keys(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), TWO_KEYS), TWO_KEYS)


LATER_STEPS = [("event_type = 'signup'", 1, 0), ("event_type = 'click'", 3, H36), ("event_type = 'purchase'", 1, 0)]


@query(f"WITH {EV}, {chain_sql(LATER_STEPS, 'user_id', D6)} SELECT user_id AS k0, start_us, end_us FROM fired")
def sequence_count_later_step(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), LATER_COUNT), LATER_COUNT)


@query(f"WITH {EV}, {chain_sql([('event_type = ' + repr('error'), 1, 0), ('event_type = ' + repr('purchase') + ' AND value > 50', 1, 0)], 'hi_k', D2)} SELECT CAST(hi_k AS VARCHAR) AS k0, start_us, end_us FROM fired")
def sequence_null_key(spark, sf_dir):
    return flat(match(table_events(spark, sf_dir), NULL_KEY), NULL_KEY)


@query(f"""WITH {CHAIN_SQL}, r AS (SELECT user_id, t, lead(t, 2) OVER (PARTITION BY user_id ORDER BY t) AS e FROM ev WHERE event_type = 'error'),
  x AS (SELECT DISTINCT r.user_id FROM r JOIN ev s ON s.user_id = r.user_id AND s.event_type = 'signup' AND s.t > r.e JOIN ev q ON q.user_id = r.user_id AND q.event_type = 'purchase' AND q.t > s.t WHERE r.e - r.t <= {H48} AND q.t - r.t <= {D5})
  SELECT CAST((SELECT count(*) FROM fired) AS BIGINT) AS greedy, CAST((SELECT count(*) FROM x) AS BIGINT) AS any_start""")
def greedy_vs_exhaustive(spark, sf_dir):
    e = table_events(spark, sf_dir)
    counts = match(e, FLAGSHIP).select(F.lit("greedy").alias("mode")).union(match_any_start(e, FLAGSHIP).select(F.lit("any_start")))
    return counts.agg(F.count_if(F.col("mode") == "greedy").alias("greedy"), F.count_if(F.col("mode") == "any_start").alias("any_start"))


GUARD_TEXT = GUARDED.exceptions[0].describe().replace("'", "''")
GUARD_SQL = f"""WITH {CHAIN_SQL}, m AS (SELECT f.user_id AS k0, start_us, end_us, EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'view' AND x.value >= 120 AND x.user_id = f.user_id AND x.t BETWEEN f.start_us - {micros('24h')} AND f.end_us) AS hit FROM fired f)"""


@query(f"{GUARD_SQL} SELECT k0, start_us, end_us, NOT hit AS triggered, CASE WHEN hit THEN '{GUARD_TEXT}' ELSE '' END AS reasons FROM m")
def suppression(spark, sf_dir):
    return evaluate(table_events(spark, sf_dir), GUARDED).select("k0", "start_us", "end_us", "triggered", F.array_join("suppressed_by", "; ").alias("reasons"))


DEVICE_SQL = f"""WITH {EV}, {chain_sql([(f"event_type = '{x}'", 1, 0) for x in ('error', 'signup', 'purchase')], 'device_id', D2)},
  m AS (SELECT device_id AS k0, start_us, end_us, EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'view' AND x.value >= 120 AND x.t BETWEEN f.start_us - 60000000 AND f.end_us) AS hit FROM fired f)"""


@query(f"{DEVICE_SQL} SELECT k0, start_us, end_us, NOT hit AS triggered FROM m")
def suppression_all_actors(spark, sf_dir):
    return evaluate(table_events(spark, sf_dir), BY_DEVICE).select("k0", "start_us", "end_us", "triggered")


@query(f"{GUARD_SQL} SELECT {case_sql(GUARDED, ['k0'])} AS case_id, start_us FROM m")
def case_ids(spark, sf_dir):
    return evaluate(table_events(spark, sf_dir), GUARDED).select("case_id", "start_us")


@query(f"""{GUARD_SQL}, a AS (SELECT '{FLAGSHIP.id}' AS detection_id, {case_sql(FLAGSHIP, ['k0'])} AS case_id, start_us, true AS triggered FROM m UNION ALL SELECT '{GUARDED.id}', {case_sql(GUARDED, ['k0'])}, start_us, NOT hit FROM m),
  b AS ({DEVICE_SQL} SELECT '{BY_DEVICE.id}' AS detection_id, {case_sql(BY_DEVICE, ['k0'])} AS case_id, start_us, NOT hit AS triggered FROM m) SELECT * FROM a UNION ALL SELECT * FROM b""")
def pack_evaluate(spark, sf_dir):
    return evaluate_pack(prepare(table_events(spark, sf_dir)), [FLAGSHIP, GUARDED, BY_DEVICE]).select("detection_id", "case_id", "start_us", "triggered")


@query(f"{GUARD_SQL} SELECT CAST(count(*) AS BIGINT) AS matches, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS alerts, CAST(count(*) FILTER (hit) AS BIGINT) AS suppressed FROM m")
def result_views(spark, sf_dir):
    return evaluate(table_events(spark, sf_dir), GUARDED).agg(F.count("*").alias("matches"), F.count_if("triggered").alias("alerts"), F.count_if(~F.col("triggered")).alias("suppressed"))


@query(f"WITH {CHAIN_SQL} SELECT user_id AS k0, start_us, end_us FROM fired")
def spark_sql_export(spark, sf_dir):
    steps = relevant(table_events(spark, sf_dir), FLAGSHIP).select("k0", "pos.t", "pos.id", *[f"is{i}" for i in range(3)])
    return spark.sql(spark_sql(FLAGSHIP, "{steps}"), steps=steps)


LATE = f"{EV}, w AS (SELECT *, max(t) OVER (ORDER BY observed_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {micros('5m')} AS mark FROM ev)"


@query(f"WITH {LATE} SELECT event_id, mark AS watermark_us, coalesce(t < mark, false) AS late FROM w")
def late_admission(spark, sf_dir):
    return admission(table_events(spark, sf_dir)).select("event_id", "watermark_us", "late")


@query(f"WITH {EV} SELECT event_id, CAST((observed_us - t) AS DOUBLE) / 1000000 AS lateness FROM ev")
def lateness_by_event(spark, sf_dir):
    return lateness_seconds(table_events(spark, sf_dir))


@query(f"WITH {LATE}, adm AS (SELECT * FROM w WHERE NOT coalesce(t < mark, false)), {chain_sql(CHAIN_STEPS, 'user_id', D5, 'adm')} SELECT user_id AS k0, start_us, end_us FROM fired")
def stream_admitted_matches(spark, sf_dir):
    return flat(match(prepare(first_arrivals(admission(table_events(spark, sf_dir)).where("NOT late"))), FLAGSHIP), FLAGSHIP)


COVERED = Detection("TW-0012", "Predicates", Sequence("1d", [Event("error").where(hi_k__gte=60), Event("view").where(value__gt=1, hi_k__lt=90)]))


@query(f"WITH {EV} SELECT event_type, field, CAST(count(v) AS DOUBLE) / count(*) AS coverage FROM (SELECT event_type, 'hi_k' AS field, CAST(hi_k AS DOUBLE) AS v FROM ev WHERE event_type IN ('error', 'view') UNION ALL SELECT event_type, 'value', value FROM ev WHERE event_type = 'view') GROUP BY ALL")
def field_coverage(spark, sf_dir):
    return lab.field_coverage(table_events(spark, sf_dir), COVERED)


@query(f"WITH {EV} SELECT source FROM ev GROUP BY source ORDER BY count(*) DESC, source DESC LIMIT 1")
def dominant_source(spark, sf_dir):
    return lab.dominant_source(table_events(spark, sf_dir))


PLAIN_MATCHES = f"WITH {CHAIN_SQL} SELECT user_id AS k0, start_us, end_us FROM fired"


def _mutated(change):
    return lambda spark, sf_dir: flat(match(prepare(change(table_events(spark, sf_dir))), FLAGSHIP), FLAGSHIP)


for _name, _change in {"shuffle": lab.shuffled, "duplicate": lab.duplicated, "lateness": lab.delayed, "reconnect": lab.reconnected}.items():
    QUERIES[f"mut_{_name}"] = _mutated(_change)
    ORACLE_SQL[f"mut_{_name}"] = PLAIN_MATCHES
QUERIES["mut_skew"] = _mutated(lambda e: lab.skewed(e, "monitor", "6h"))
ORACLE_SQL["mut_skew"] = f"WITH {EV}, sk AS (SELECT *, t + CASE WHEN source = 'monitor' THEN {micros('6h')} ELSE 0 END AS u FROM ev), {chain_sql(CHAIN_STEPS, 'user_id', D5, 'sk', 'u')} SELECT user_id AS k0, start_us, end_us FROM fired"
QUERIES["mut_drop_type"] = lambda spark, sf_dir: evaluate(prepare(lab.without_type(table_events(spark, sf_dir), "view")), GUARDED).select("k0", "start_us", "end_us", "triggered")
ORACLE_SQL["mut_drop_type"] = f"WITH {CHAIN_SQL} SELECT user_id AS k0, start_us, end_us, true AS triggered FROM fired"
QUERIES["mut_drop_field"] = lambda spark, sf_dir: lab.without_field(table_events(spark, sf_dir), "value").where(predicate("value", "ne", 5) & predicate("hi_k", "exists", True)).select("event_id")
ORACLE_SQL["mut_drop_field"] = f"WITH {EV} SELECT event_id FROM ev WHERE hi_k IS NOT NULL"


DURABILITY_SQL = f"""WITH {CHAIN_SQL}, v AS (SELECT user_id, t FROM ev WHERE event_type = 'view' AND value >= 120),
  m AS (SELECT {case_sql(GUARDED, ['f.user_id'])} AS case_id, EXISTS (SELECT 1 FROM v WHERE v.user_id = f.user_id AND v.t BETWEEN f.start_us - {micros('24h')} AND f.end_us) AS hit,
    EXISTS (SELECT 1 FROM v WHERE v.user_id = f.user_id AND v.t + {micros('5m')} BETWEEN f.start_us - {micros('24h')} AND f.end_us) AS late FROM fired f),
  b AS (SELECT count(*) FILTER (NOT hit) AS n, string_agg(case_id, ',' ORDER BY case_id) FILTER (NOT hit) AS base, count(*) FILTER (NOT late) AS ns, string_agg(case_id, ',' ORDER BY case_id) FILTER (NOT late) AS skew, count(*) AS ne, string_agg(case_id, ',' ORDER BY case_id) AS every FROM m)
  SELECT probe, CAST(cases AS INTEGER) AS cases, holds FROM (SELECT unnest(['reordering', 'duplicates', 'late events', 'reconnect']) AS probe, n AS cases, true AS holds, n FROM b
    UNION ALL SELECT 'clock skew', ns, coalesce(skew = base, false), n FROM b UNION ALL SELECT unnest(['missing type', 'missing field']), ne, coalesce(every = base, false), n FROM b) WHERE n > 0"""


@query(DURABILITY_SQL)
def durability(spark, sf_dir):
    return lab.durability(prepare(table_events(spark, sf_dir)), GUARDED, "view", "value", "web")


TIGHT_STEPS = [("event_type = 'error' AND coalesce(hi_k >= 50, false)", 4, H48), *CHAIN_STEPS[1:]]


@query(f"""SELECT 'TW-0001' AS detection_id, o.n > 0 AS old_fired, w.n > 0 AS new_fired, CASE WHEN o.n > 0 THEN 5 ELSE 0 END AS old_support, CASE WHEN w.n > 0 THEN 6 ELSE 0 END AS new_support, 'error: hi_k ≥ 50' AS added, '' AS removed,
  CASE WHEN o.n > 0 AND w.n = 0 THEN format('hi_k is present in {{:.1f}}% of error events', 100 * c.share) ELSE '' END AS cause
  FROM (WITH {CHAIN_SQL} SELECT count(*) AS n FROM fired) o, (WITH {EV}, {chain_sql(TIGHT_STEPS, 'user_id', D5)} SELECT count(*) AS n FROM fired) w, (WITH {EV} SELECT CAST(count(hi_k) AS DOUBLE) / count(*) AS share FROM ev WHERE event_type = 'error') c""")
def rule_diff(spark, sf_dir):
    d = lab.rule_diff(table_events(spark, sf_dir), FLAGSHIP, TIGHT)
    return spark.createDataFrame([(d.detection_id, *d.fired, *d.support, "; ".join(d.added), "; ".join(d.removed), d.cause)], "detection_id string, old_fired boolean, new_fired boolean, old_support int, new_support int, added string, removed string, cause string")


TWO_EXCEPTIONS = Detection("TW-0013", "Two ways out", CHAIN, exceptions=[Absence(Event("view").where(value__gte=140), "6h"), Absence(Event("click").where(hi_k__gte=95), "30m")])
TWO_TEXTS = [x.describe().replace("'", "''") for x in TWO_EXCEPTIONS.exceptions]


@query(f"""WITH {CHAIN_SQL}, h AS (SELECT f.user_id, start_us, EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'view' AND x.value >= 140 AND x.user_id = f.user_id AND x.t BETWEEN f.start_us - {micros('6h')} AND f.end_us) AS a,
  EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'click' AND x.hi_k >= 95 AND x.user_id = f.user_id AND x.t BETWEEN f.start_us - {micros('30m')} AND f.end_us) AS b FROM fired f)
  SELECT user_id AS k0, start_us, concat_ws('; ', CASE WHEN a THEN '{TWO_TEXTS[0]}' END, CASE WHEN b THEN '{TWO_TEXTS[1]}' END) AS reasons FROM h""")
def two_exceptions(spark, sf_dir):
    return evaluate(table_events(spark, sf_dir), TWO_EXCEPTIONS).select("k0", "start_us", F.array_join("suppressed_by", "; ").alias("reasons"))


def _raw_events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("n"), "event_type", F.col("user_id").cast("string").alias("user"), (micros_of(F.col("ts")) / 1_000_000).cast("bigint").alias("s"), "value")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'osq-' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) ELSE 'o' || CAST(event_id AS VARCHAR) END AS event_id, 'process.execution' AS event_type, epoch_us(ts) // 1000000 * 1000000 AS event_us, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 2 = 0 THEN 'tar' ELSE event_type END AS process FROM events")
def source_osquery(spark, sf_dir):
    n = F.col("n").cast("string")
    none = F.lit(None).cast("string")
    columns = F.struct(F.when(F.col("n") % 2 == 1, F.col("event_type")).alias("name"), F.lit("/usr/bin/tar").alias("path"), F.col("user").alias("username"), none.alias("uid"), n.alias("pid"), none.alias("parent"), none.alias("cmdline"), none.alias("cwd"))
    raw = _raw_events(spark, sf_dir).select(F.when(F.col("n") % 3 != 0, F.concat(F.lit("o"), n)).alias("eventid"), F.lit("p").alias("name"), F.col("s").cast("string").alias("unixTime"), F.lit("h").alias("hostIdentifier"), columns.alias("columns"))
    return from_osquery(raw).select("event_id", "event_type", "event_us", "actor.user_id", F.try_variant_get(F.col("attributes")["process_name"], "$", "string").alias("process"))


@query("SELECT 'z' || CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) // 1000000 * 1000000 + 500000 AS event_us, 'd' || CAST(event_id % 7 AS VARCHAR) AS device_id, CAST(event_id % 1000 AS BIGINT) AS bytes_out FROM events")
def source_zeek(spark, sf_dir):
    raw = _raw_events(spark, sf_dir).select((F.col("s") + 0.5).alias("ts"), F.concat(F.lit("z"), F.col("n").cast("string")).alias("uid"), F.concat(F.lit("d"), (F.col("n") % 7).cast("string")).alias("id.orig_h"), F.lit("x").alias("id.resp_h"), F.lit(443).alias("id.resp_p"), (F.col("n") % 1000).alias("orig_bytes"), F.lit(1).alias("resp_bytes"), F.lit("tcp").alias("proto"))
    return from_zeek_conn(raw).select("event_id", "event_us", F.col("device.id").alias("device_id"), F.try_variant_get(F.col("attributes")["bytes_out"], "$", "bigint").alias("bytes_out"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'g' || CAST(event_id AS VARCHAR) ELSE 'gh-' || CAST(epoch_us(ts) // 1000000 * 1000 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) END AS event_id, CASE event_type WHEN 'click' THEN 'github.repository.clone' WHEN 'signup' THEN 'github.token.create' ELSE 'github.' || event_type END AS event_type, CASE WHEN event_type = 'click' THEN 'normal' END AS sensitivity FROM events")
def source_github(spark, sf_dir):
    none, kind = F.lit(None).cast("string"), F.col("event_type")
    action = F.when(kind == "click", "git.clone").when(kind == "signup", "personal_access_token.create").otherwise(kind)
    raw = _raw_events(spark, sf_dir).select(action.alias("action"), (F.col("s") * 1000).alias("@timestamp"), F.col("user").alias("actor"), none.alias("actor_email"), F.lit("r").alias("repo"), none.alias("repository_visibility"), none.alias("token_name"), none.alias("scopes"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("g"), F.col("n").cast("string"))).alias("_document_id"))
    return from_github_audit(raw).select("event_id", "event_type", F.try_variant_get(F.col("attributes")["repository_sensitivity"], "$", "string").alias("sensitivity"))


@query("SELECT 'c' || CAST(event_id AS VARCHAR) AS event_id, CASE event_type WHEN 'view' THEN 'aws.s3.get_object' WHEN 'signup' THEN 'iam.user.create' ELSE 'aws.' || event_type END AS event_type, epoch_us(ts) // 1000000 * 1000000 AS event_us, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'view' THEN 'b' END AS bucket FROM events")
def source_cloudtrail(spark, sf_dir):
    none, kind = F.lit(None).cast("string"), F.col("event_type")
    name = F.when(kind == "view", "GetObject").when(kind == "signup", "CreateUser").otherwise(F.initcap(kind))
    time = iso_text(F.col("s") * 1_000_000)
    raw = _raw_events(spark, sf_dir).select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("eventID"), name.alias("eventName"), time.alias("eventTime"), none.alias("awsRegion"), F.struct(none.alias("userName"), F.col("user").alias("principalId"), none.alias("arn")).alias("userIdentity"), F.struct(F.lit("b").alias("bucketName"), none.alias("key"), none.alias("userName")).alias("requestParameters"))
    return from_cloudtrail(raw).select("event_id", "event_type", "event_us", "actor.user_id", F.try_variant_get(F.col("attributes")["bucket"], "$", "string").alias("bucket"))


def _lines(spark, sf_dir) -> DataFrame:
    """The events as JSON lines, some of them damaged."""
    n = F.col("n").cast("string")
    good = F.to_json(F.struct(n.alias("event_id"), F.col("event_type"), iso_text(F.col("s") * 1_000_000).alias("event_time"), F.struct(F.col("user").alias("user_id")).alias("actor"), F.col("value")))
    return _raw_events(spark, sf_dir).select(F.when(F.col("n") % 10 == 3, F.concat(F.lit("{broken "), n)).when(F.col("n") % 10 == 4, F.concat(F.lit('{"event_id": "'), n, F.lit('"}'))).when(F.col("n") % 10 == 5, F.lit("  ")).otherwise(good).alias("value"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, epoch_us(ts) // 1000000 * 1000000 AS event_us, CAST(user_id AS VARCHAR) AS user_id, value FROM events WHERE event_id % 10 NOT IN (3, 4, 5)")
def source_json(spark, sf_dir):
    return normalise_json(_lines(spark, sf_dir)).select("event_id", "event_type", "event_us", "actor.user_id", F.try_variant_get(F.col("attributes")["value"], "$", "double").alias("value"))


@query("SELECT CASE WHEN event_id % 10 = 3 THEN '{broken ' || CAST(event_id AS VARCHAR) ELSE '{\"event_id\": \"' || CAST(event_id AS VARCHAR) || '\"}' END AS value FROM events WHERE event_id % 10 IN (3, 4)")
def source_rejects(spark, sf_dir):
    return rejects(_lines(spark, sf_dir))


def telemetry(spark, sf_dir) -> DataFrame:
    """The events table in the words of security telemetry, so that signals and timelines have something to find."""
    e = table_events(spark, sf_dir)
    k, kind = F.try_variant_get(F.col("attributes")["k"], "$", "bigint"), F.col("event_type")
    types = {"click": "github.repository.clone", "view": "process.execution", "error": "security.telemetry_state", "purchase": "filesystem.write", "signup": "github.token.create"}
    named = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[kind]
    attributes = variants(
        repository_sensitivity=F.when(kind == "click", F.when(k >= 90, "restricted").otherwise("normal")), access_is_first_seen=F.when(kind == "click", k >= 97), process_name=F.when(kind == "view", F.when(k % 25 == 0, "gpg").otherwise("bash")),
        destination_type=F.when(kind == "purchase", F.when(k % 10 == 3, "usb").otherwise("disk")), state=F.when(kind == "error", F.when(k < 50, "stopped").otherwise("running")), telemetry_source=F.when(kind == "error", F.when(k % 2 == 0, "endpoint").otherwise("audit")),
    )
    source = F.when(kind == "click", "github_audit").when(kind == "view", "osquery").when(kind == "purchase", "zeek").otherwise("okta")
    return e.withColumn("attributes", attributes).withColumn("provenance", struct_of("struct<source:string,collector:string,ingested_us:bigint,confidence:double,raw_ref:string>", source=source)).withColumn("event_type", named)


EXFIL = Detection("TW-0020", "Stops, then a token, then a write", Sequence("5d", [Count(Event("security.telemetry_state"), 3, "48h"), Event("github.token.create"), Event("filesystem.write")]), "critical")
EXFIL_CASE = case_sql(EXFIL, ["user_id"])
SCOPE_SQL = f"""{CHAIN_SQL}, al AS (SELECT user_id, start_us, end_us, {EXFIL_CASE} AS case_id FROM fired), us AS (SELECT u.event_id, u.step, u.t, a.case_id FROM used u JOIN al a USING (user_id) WHERE u.step IS NOT NULL),
  sc AS (SELECT al.case_id, ev.*, CASE event_type WHEN 'click' THEN 'github_audit' WHEN 'view' THEN 'osquery' WHEN 'purchase' THEN 'zeek' ELSE 'okta' END AS src, us.step FROM al JOIN ev USING (user_id) LEFT JOIN us ON us.case_id = al.case_id AND us.event_id = ev.event_id)"""
SIGNAL_SQL = f"""{SCOPE_SQL}, sg AS (SELECT case_id, count(*) FILTER (event_type = 'click' AND k >= 90) >= 5 AS bulk_restricted_clone, bool_or(event_type = 'click' AND k >= 97) AS first_seen_access, bool_or(event_type = 'view' AND k % 25 = 0) AS archive_created,
  bool_or(event_type = 'purchase' AND k % 10 = 3) AS removable_media_write, bool_or(event_type = 'error' AND k < 50 AND k % 2 = 0) AS endpoint_telemetry_stopped, bool_or(event_type = 'error' AND k < 50) AS logging_disabled, false AS shell_history_deleted,
  bool_or(event_type = 'signup') AS new_token_created, false AS cloud_object_retrieval, false AS temp_identity_created, false AS temp_identity_deleted, bool_or(step IS NOT NULL AND n % 2 = 0) AS device_enrolled FROM sc GROUP BY case_id)"""
FACTS = {"legitimate_access": True, "unseen_device": True}


def _alerts(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return e, evaluate(e, EXFIL).where("triggered")


@query(f"WITH {SCOPE_SQL} SELECT case_id, event_id FROM sc")
def actor_scope(spark, sf_dir):
    return investigate.scoped_events(*_alerts(spark, sf_dir)).select("case_id", "event_id")


@query(f"WITH {SIGNAL_SQL} SELECT * FROM sg")
def signals(spark, sf_dir):
    return investigate.signals(investigate.scoped_events(*_alerts(spark, sf_dir)))


def _score_sql() -> str:
    """Scores by SQL: facts are constants, signals that nothing shows are false."""
    shown = {"bulk_restricted_clone", "first_seen_access", "archive_created", "removable_media_write", "endpoint_telemetry_stopped", "logging_disabled", "new_token_created", "device_enrolled"}
    parts = []
    for h, _, bad, prior in investigate.HYPOTHESES:
        term = lambda s, w: f"CASE WHEN {s} THEN {w} ELSE 0.0 END" if s in shown else str(w if FACTS.get(s) else 0.0)
        plus = " + ".join(["CAST(0 AS DOUBLE)", *[f"CAST({term(s, w)} AS DOUBLE)" for s, w, up in investigate.INDICATORS[h] if up]])
        minus = " + ".join(["CAST(0 AS DOUBLE)", *[f"CAST({term(s, w)} AS DOUBLE)" for s, w, up in investigate.INDICATORS[h] if not up]])
        parts.append(f"SELECT case_id, '{h}' AS hypothesis, {str(bad).lower()} AS malicious, {prior} + ({plus}) - ({minus}) AS score, {plus} AS support FROM sg")
    return f"{SIGNAL_SQL}, sco AS ({' UNION ALL '.join(parts)}), pr AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY case_id) AS probability FROM sco), rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(probability, 12) DESC, hypothesis) AS rank FROM pr)"


SCORE_SQL = _score_sql()


@query(f"WITH {SCORE_SQL} SELECT case_id, hypothesis, round(score, 6) AS score, round(probability, 6) AS probability FROM rk")
def hypothesis_scores(spark, sf_dir):
    found = investigate.with_facts(investigate.signals(investigate.scoped_events(*_alerts(spark, sf_dir))), FACTS)
    return investigate.hypothesis_scores(found).select("case_id", "hypothesis", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query(f"""WITH {SCORE_SQL}, f AS (SELECT * FROM rk WHERE rank = 1), o AS (SELECT rk.case_id, rk.hypothesis, row_number() OVER (PARTITION BY rk.case_id ORDER BY rk.malicious <> f.malicious DESC, CASE WHEN rk.malicious <> f.malicious THEN rk.support ELSE 0 END DESC, rk.probability DESC, rk.hypothesis DESC) AS place FROM rk JOIN f USING (case_id) WHERE rk.rank > 1)
  SELECT f.case_id, f.hypothesis AS "primary", o.hypothesis AS alternative, CAST(round_even(100 * f.probability * CASE WHEN f.malicious THEN 1 ELSE 0.25 END, 0) AS BIGINT) AS risk, CASE WHEN f.probability >= 0.85 THEN 'High' WHEN f.probability >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence,
  'ARI-2026-' || rpad(substr(regexp_replace(f.case_id, '[^0-9]', '', 'g'), 1, 4), 4, '0') AS case_number FROM f JOIN o ON o.case_id = f.case_id AND place = 1""")
def case_rows(spark, sf_dir):
    return investigate.cases(telemetry(spark, sf_dir), EXFIL, FACTS).select("case_id", "primary", "alternative", "risk", "confidence", "case_number")


@query(f"WITH {SCOPE_SQL} SELECT case_id, event_id, t AS event_us FROM us")
def minimal_evidence(spark, sf_dir):
    return investigate.decisive_evidence(_alerts(spark, sf_dir)[1]).select("case_id", "event_id", "event_us")


@query(f"WITH {SCOPE_SQL} SELECT case_id, CAST(step AS INTEGER) AS step, CAST(count(*) AS BIGINT) AS events, max(t) - min(t) AS span_us FROM us GROUP BY ALL")
def explain_steps(spark, sf_dir):
    return investigate.explanation(_alerts(spark, sf_dir)[1], EXFIL).where("events > 0").select("case_id", "step", "events", "span_us")


def _against_sql() -> str:
    """A row for each note that speaks against the first hypothesis."""
    shown = {"removable_media_write", "device_enrolled", "endpoint_telemetry_stopped"}
    notes = [(h, s, n) for (h, s), n in investigate.NOTES.items() if s in shown]
    return " UNION ALL ".join(f"SELECT f.case_id, '{n[0].upper() + n[1:].lower()}' AS text FROM f JOIN sg USING (case_id) WHERE hypothesis = '{h}' AND sg.{s}" for h, s, n in notes)


@query(f"""WITH {SCORE_SQL}, f AS (SELECT * FROM rk WHERE rank = 1), co AS ({_against_sql()} UNION ALL SELECT case_id, '{investigate.ENROLLED}' FROM sg WHERE device_enrolled)
  SELECT case_id, 'supporting' AS register, CASE WHEN step = 0 THEN '3 security.telemetry_state events' WHEN step = 1 THEN 'github.token.create' ELSE 'Data staged to ' || max(CASE WHEN k % 10 = 3 THEN 'usb' ELSE 'disk' END) END AS text, string_agg(event_id, ',' ORDER BY t, event_id) AS ids FROM sc WHERE step IS NOT NULL GROUP BY case_id, step
  UNION ALL SELECT case_id, 'supporting', 'First-ever access to restricted repositories', string_agg(event_id, ',' ORDER BY t, event_id) FROM sc WHERE event_type = 'click' AND k >= 97 GROUP BY case_id
  UNION ALL SELECT case_id, 'supporting', 'New access token created shortly before activity', string_agg(event_id, ',' ORDER BY t, event_id) FROM sc WHERE event_type = 'signup' GROUP BY case_id
  UNION ALL SELECT DISTINCT case_id, 'contradictory', text, '' FROM co""")
def evidence_rows(spark, sf_dir):
    found = investigate.investigate(telemetry(spark, sf_dir), EXFIL, FACTS)
    return investigate.evidence(found).select("case_id", "register", F.regexp_replace("text", " within .*$", "").alias("text"), F.array_join("event_ids", ",").alias("ids"))


@query(f"WITH {SCORE_SQL} SELECT case_id, CASE hypothesis WHEN 'H2' THEN '{investigate.THESES['H2']}' WHEN 'H5' THEN '{investigate.THESES['H5']}' WHEN 'H1' THEN 'Malicious insider collection' WHEN 'H3' THEN 'Most consistent with: Authorized migration' WHEN 'H4' THEN 'Most consistent with: Security-team testing' ELSE 'Most consistent with: Broken automation' END AS thesis FROM rk WHERE rank = 1")
def case_theses(spark, sf_dir):
    return investigate.cases(telemetry(spark, sf_dir), EXFIL, FACTS).select("case_id", "thesis")


#: The incidents that come with the library, and what a replay of the pack has to find in them.
@query("SELECT * FROM (VALUES ('compromised-developer', 512, 1, 1, 'H2'), ('departing-engineer', 625, 1, 1, 'H1'), ('privileged-admin', 517, 1, 1, 'H5')) AS t(scenario, events, triggered, cases, \"primary\")")
def scenario_replay(spark, sf_dir):
    from tidewatch.plans import pack, scenario

    reports = [scenario.replay(s, pack.DETECTIONS, with_durability=False) for s in scenario.builtin(spark).values()]
    rows = [(r.scenario_id, r.events_processed, r.detections_triggered, len(r.cases), r.cases[0].row["primary"] if r.cases else None) for r in reports]
    return spark.createDataFrame(rows, "scenario string, events int, triggered int, cases int, primary string")


GAP_SQL = f"""{SCOPE_SQL}, st AS (SELECT case_id, event_id, t, CASE WHEN k % 2 = 0 THEN 'endpoint' ELSE 'audit' END AS stopped FROM sc WHERE event_type = 'error' AND k < 50),
  li AS (SELECT case_id, event_id, t, src, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'endpoint' ELSE 'audit' END END AS named FROM sc WHERE src IN ('zeek', 'github_audit', 'okta')),
  gp AS (SELECT st.case_id, st.event_id, st.t AS event_us, stopped || ' telemetry stopped while ' || arg_min(li.src, (li.t, li.event_id)) || ' stayed live — selective blinding' AS summary FROM st JOIN li ON li.case_id = st.case_id AND (li.t > st.t OR li.t = st.t AND li.event_id > st.event_id) AND li.named IS DISTINCT FROM st.stopped GROUP BY st.case_id, st.event_id, st.t, stopped)"""


@query(f"WITH {GAP_SQL} SELECT case_id, event_id, event_us, summary FROM gp")
def timeline_gaps(spark, sf_dir):
    return investigate.telemetry_gaps(investigate.scoped_events(*_alerts(spark, sf_dir)))


@query(f"""WITH {GAP_SQL} SELECT case_id, t AS event_us, false AS is_gap, event_id, CASE event_type WHEN 'click' THEN 'clone ? (sensitivity=' || CASE WHEN k >= 90 THEN 'restricted' ELSE 'normal' END || ')' WHEN 'view' THEN 'process ' || CASE WHEN k % 25 = 0 THEN 'gpg' ELSE 'bash' END
  WHEN 'purchase' THEN 'write to ' || CASE WHEN k % 10 = 3 THEN 'usb' ELSE 'disk' END WHEN 'error' THEN 'telemetry ' || CASE WHEN k < 50 THEN 'stopped' ELSE 'running' END || ' (?)' ELSE 'GitHub access token created' END AS summary FROM sc
  UNION ALL SELECT case_id, event_us, true, event_id, summary FROM gp""")
def timeline(spark, sf_dir):
    return investigate.timeline(investigate.scoped_events(*_alerts(spark, sf_dir))).drop("event_type")


@query(f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) = 1 AS is_first_seen FROM ev")
def first_seen_access(spark, sf_dir):
    return first_seen(table_events(spark, sf_dir), [F.col("actor.user_id"), F.col("event_type")]).select("event_id", "is_first_seen")


LINK_SQL = f"{EV}, g AS (SELECT DISTINCT 'u' || user_id AS a, 'k' || CAST(k AS VARCHAR) || '_' || CAST(CAST(user_id AS BIGINT) % 10 AS VARCHAR) AS b FROM ev WHERE event_type = 'purchase' AND value >= 100)"


def _links(spark, sf_dir) -> DataFrame:
    e = table_events(spark, sf_dir).where((F.col("event_type") == "purchase") & predicate("value", "gte", 100))
    k = F.try_variant_get(F.col("attributes")["k"], "$", "bigint")
    user = F.col("actor.user_id")
    return e.select(F.concat(F.lit("u"), user).alias("a"), F.concat(F.lit("k"), k.cast("string"), F.lit("_"), (user.cast("bigint") % 10).cast("string")).alias("b")).distinct()


def _assertions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pairs = _links(spark, sf_dir)
    users = pairs.select(F.lit("user").alias("type"), F.col("a").alias("value"), F.lit("app").alias("source"), F.lit(0.9).alias("confidence")).distinct()
    keys = pairs.select(F.lit("key").alias("type"), F.col("b").alias("value"), F.lit("web").alias("source"), F.lit(0.5).alias("confidence")).distinct()
    again = keys.withColumn("source", F.lit("log")).withColumn("confidence", F.lit(0.8))
    links = pairs.select(F.lit("user").alias("left_type"), F.col("a").alias("left_value"), F.lit("key").alias("right_type"), F.col("b").alias("right_value"), F.lit(0.95).alias("confidence"), F.lit(1).alias("seq"))
    return users.union(keys).union(again), links


@query(f"WITH {LINK_SQL} SELECT 'user' AS type, a AS value, CAST(0.9 AS DOUBLE) AS confidence, 'app' AS sources FROM g GROUP BY a UNION ALL SELECT 'key', b, CAST(0.8 AS DOUBLE), 'log, web' FROM g GROUP BY b")
def identity_nodes(spark, sf_dir):
    return identity.nodes(_assertions(spark, sf_dir)[0]).select("type", "value", "confidence", F.array_join("sources", ", ").alias("sources"))


COMPONENT_SQL = f"""WITH RECURSIVE {LINK_SQL}, bo AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), re AS (SELECT x AS node, x AS seen FROM bo UNION SELECT re.node, bo.y FROM re JOIN bo ON bo.x = re.seen), co AS (SELECT node, min(seen) AS component FROM re GROUP BY node)"""


@query(f"{COMPONENT_SQL} SELECT node, component FROM co")
def identity_components(spark, sf_dir):
    return connected_components(_links(spark, sf_dir), "a", "b")


@query(f"""{COMPONENT_SQL} SELECT 'person-' || substr(sha256(string_agg(CASE WHEN node LIKE 'u%' THEN 'user:' ELSE 'key:' END || node, '|' ORDER BY CASE WHEN node LIKE 'u%' THEN 'user:' ELSE 'key:' END || node)), 1, 6) AS principal_id, CAST(count(*) AS BIGINT) AS atoms FROM co GROUP BY component""")
def principal_ids(spark, sf_dir):
    return identity.resolve(*_assertions(spark, sf_dir)).groupBy("principal_id").agg(F.count("*").alias("atoms"))


@query(f"""{COMPONENT_SQL}, an AS (SELECT component, max(node) FILTER (node LIKE 'u%') AS anchor FROM co GROUP BY component),
  d0 AS (SELECT anchor AS node FROM an), d1 AS (SELECT node FROM d0 UNION SELECT y FROM d0 JOIN bo ON x = node), d2 AS (SELECT node FROM d1 UNION SELECT y FROM d1 JOIN bo ON x = node), d3 AS (SELECT node FROM d2 UNION SELECT y FROM d2 JOIN bo ON x = node),
  d4 AS (SELECT node FROM d3 UNION SELECT y FROM d3 JOIN bo ON x = node), d5 AS (SELECT node FROM d4 UNION SELECT y FROM d4 JOIN bo ON x = node), d6 AS (SELECT node FROM d5 UNION SELECT y FROM d5 JOIN bo ON x = node),
  hop AS (SELECT node, min(h) AS h FROM (SELECT node, 0 AS h FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3 UNION ALL SELECT node, 4 FROM d4 UNION ALL SELECT node, 5 FROM d5 UNION ALL SELECT node, 6 FROM d6) GROUP BY node)
  SELECT co.node AS value, round(CASE WHEN co.node LIKE 'u%' THEN 0.9 ELSE 0.8 END * CASE WHEN h IS NULL THEN 0 ELSE pow(0.95, h) END, 9) AS confidence FROM co LEFT JOIN hop ON hop.node = co.node""")
def identity_paths(spark, sf_dir):
    return identity.resolve(*_assertions(spark, sf_dir)).select("value", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {EV} SELECT user_id, round(1 - product(1 - k / 200.0), 9) AS noisy, round(product(k / 100.0), 9) AS path FROM ev WHERE event_type = 'signup' GROUP BY user_id")
def noisy_or(spark, sf_dir):
    k = F.try_variant_get(F.col("attributes")["k"], "$", "double")
    e = table_events(spark, sf_dir).where("event_type = 'signup'").select("actor.user_id", (k / 200).alias("c"), (k / 100).alias("p"))
    return e.groupBy("user_id").agg(F.round(identity.noisy_or("c"), 9).alias("noisy"), F.round(identity.path_confidence("p"), 9).alias("path"))


@query(f"{COMPONENT_SQL}, id AS (SELECT component, 'person-' || substr(sha256(string_agg(CASE WHEN node LIKE 'u%' THEN 'user:' ELSE 'key:' END || node, '|' ORDER BY CASE WHEN node LIKE 'u%' THEN 'user:' ELSE 'key:' END || node)), 1, 6) AS principal_id FROM co GROUP BY component) SELECT ev.event_id, id.principal_id FROM ev LEFT JOIN co ON co.node = 'u' || ev.user_id LEFT JOIN id ON id.component = co.component")
def stamp_principal(spark, sf_dir):
    resolved = identity.resolve(*_assertions(spark, sf_dir)).withColumn("value", F.when(F.col("type") == "user", F.substring("value", 2, 100)).otherwise(F.col("value")))
    return identity.stamp(table_events(spark, sf_dir), resolved, "user").select("event_id", "actor.principal_id")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents")
def custody_digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return investigate.seal(docs, "text", "tidewatch", F.lit(0)).select("doc_id", "sha256", F.col("size_bytes").cast("bigint").alias("size_bytes"))

