"""Normalised events: schema, records, telemetry adapters, JSONL, and the driver's events table.

Times are microseconds since 1970 in UTC, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTOR = "struct<user_id:string,principal_id:string,username:string,email:string,source_identity:string>"
DEVICE = "struct<id:string,hostname:string,os:string,enrolled:boolean,ip:string>"
PROVENANCE = "struct<source:string,collector:string,ingested_us:bigint,confidence:double,raw_ref:string>"
COLUMNS = ("event_id", "event_type", "event_us", "observed_us", "actor", "device", "attributes", "provenance")
SPINE = ("event_id", "event_type", "event_time", "observed_time", "actor", "device", "provenance", "attributes")


def micros_of(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ that is in UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def iso_micros(text: Column) -> Column:
    """Microseconds of an ISO time; without a zone it is in UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def struct_of(kind: str, **values: Column) -> Column:
    names = [x.split(":") for x in kind[7:-1].split(",")]
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) if n in values else F.lit(None).cast(t).alias(n) for n, t in names])


def variants(**values: Column) -> Column:
    """A map of VARIANT values; null ones are left out."""
    full = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def normalise_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON records, one a row, as events; unknown top-level keys go to attributes, where explicit ones win.

    Rows that aren't objects with event_id, event_type and a valid event_time are left out; rejects() has them.
    """
    v = F.try_parse_json(F.col(column))
    top = F.try_variant_get(v, "$", "map<string,variant>")
    own = F.coalesce(F.try_variant_get(v, "$.attributes", "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    swept = F.map_filter(top, lambda k, _: ~k.isin(*SPINE) & ~F.map_contains_key(own, k))
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    part = lambda root, kind: struct_of(kind, **{n: get(f"$.{root}.{n}", t) for n, t in (x.split(":") for x in kind[7:-1].split(","))})
    return lines.select(
        get("$.event_id").alias("event_id"), get("$.event_type").alias("event_type"), iso_micros(get("$.event_time")).alias("event_us"), iso_micros(get("$.observed_time")).alias("observed_us"),
        part("actor", ACTOR).alias("actor"), part("device", DEVICE).alias("device"), F.map_concat(own, swept).alias("attributes"),
        struct_of(PROVENANCE, source=F.coalesce(get("$.provenance.source"), F.lit("unknown")), collector=get("$.provenance.collector"), ingested_us=iso_micros(get("$.provenance.ingested_at")), confidence=F.coalesce(get("$.provenance.confidence", "double"), F.lit(1.0)), raw_ref=get("$.provenance.raw_ref")).alias("provenance"),
    ).where("event_id IS NOT NULL AND event_type IS NOT NULL AND event_us IS NOT NULL")


def rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """The non-blank lines that normalise_json leaves out."""
    v = F.try_parse_json(F.col(column))
    get = lambda p: F.try_variant_get(v, p, "string")
    good = get("$.event_id").isNotNull() & get("$.event_type").isNotNull() & iso_micros(get("$.event_time")).isNotNull()
    return lines.where((F.trim(column) != "") & ~F.coalesce(good, F.lit(False)))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return normalise_json(spark.read.text(path).where(F.trim("value") != ""))


def to_json_lines(events: DataFrame) -> DataFrame:
    """One JSON object a row in canonical order (event time, id)."""
    iso = lambda c: F.when(F.col(c).isNotNull(), iso_text(F.col(c)))
    body = F.struct("event_id", "event_type", iso("event_us").alias("event_time"), iso("observed_us").alias("observed_time"), "actor", "device", "attributes", F.struct("provenance.source", "provenance.collector", "provenance.confidence", "provenance.raw_ref").alias("provenance"))
    return events.orderBy("event_us", "event_id").select(F.to_json(body).alias("value"))


def write_jsonl(events: DataFrame, path: str) -> None:
    to_json_lines(events).write.text(path)


def iso_text(us: Column) -> Column:
    """2026-02-02T22:04:00+00:00, with six more digits if there are any."""
    ntz = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    rest = F.pmod(us, F.lit(1_000_000))
    return F.concat(F.replace(F.substring(ntz.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))), F.lit("+00:00"))


def _events(raw: DataFrame, event_id, event_type, event_us, source, collector, raw_ref, attributes, actor=None, device=None) -> DataFrame:
    return raw.select(
        event_id.alias("event_id"), event_type.alias("event_type"), event_us.cast("bigint").alias("event_us"), F.lit(None).cast("bigint").alias("observed_us"),
        struct_of(ACTOR, **(actor or {})).alias("actor"), struct_of(DEVICE, **(device or {})).alias("device"), attributes.alias("attributes"),
        struct_of(PROVENANCE, source=F.lit(source), collector=F.lit(collector), confidence=F.lit(1.0), raw_ref=raw_ref).alias("provenance"),
    )


def text_or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def from_osquery(raw: DataFrame) -> DataFrame:
    """Process rows: eventid, name, unixTime (s), hostIdentifier, columns{name, path, username, uid, pid, parent, cmdline, cwd}."""
    c = F.col("columns")
    when = F.coalesce(F.col("unixTime").cast("bigint"), F.lit(0))
    event_id = text_or(F.col("eventid"), F.concat(F.lit("osq-"), F.coalesce(F.col("unixTime").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(c["pid"].cast("string"), F.lit(""))))
    name = text_or(c["name"], F.substring_index(F.coalesce(c["path"], F.lit("")), "/", -1))
    attributes = variants(process_name=name, command_line=c["cmdline"], pid=c["pid"], parent_pid=c["parent"], cwd=c["cwd"])
    return _events(raw, event_id, F.lit("process.execution"), when * 1_000_000, "osquery", "osquery", F.col("name"), attributes, {"user_id": c["username"], "source_identity": c["uid"]}, {"id": F.col("hostIdentifier"), "hostname": F.col("hostIdentifier"), "os": F.lit("linux"), "enrolled": F.lit(True)})


def from_zeek_conn(raw: DataFrame) -> DataFrame:
    """Connections: ts (s), uid, `id.orig_h`, `id.resp_h`, `id.resp_p`, orig_bytes, resp_bytes, proto."""
    host = F.col("`id.orig_h`")
    attributes = variants(destination=F.col("`id.resp_h`"), destination_port=F.col("`id.resp_p`"), bytes_out=F.col("orig_bytes"), bytes_in=F.col("resp_bytes"), proto=F.col("proto"))
    event_id = text_or(F.col("uid"), F.concat(F.lit("zeek-"), F.col("ts").cast("string")))
    return _events(raw, event_id, F.lit("network.connection"), F.round(F.coalesce(F.col("ts"), F.lit(0.0)) * 1_000_000), "zeek", "zeek", F.col("uid"), attributes, device={"id": host, "ip": host})


# Names of the sources' events.
GITHUB_TYPES = {"git.clone": "github.repository.clone", "personal_access_token.create": "github.token.create"}
CLOUDTRAIL_TYPES = {"GetObject": "aws.s3.get_object", "CreateUser": "iam.user.create", "DeleteUser": "iam.user.delete", "PutUserPolicy": "iam.policy.change", "AttachUserPolicy": "iam.policy.change"}


def named(column: Column, names: dict, other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[column], other)


def from_github_audit(raw: DataFrame) -> DataFrame:
    """Audit entries: action, `@timestamp` (ms), actor, actor_email, repo, repository_visibility, token_name, scopes, _document_id."""
    action = F.coalesce(F.col("action"), F.lit(""))
    kind = named(action, GITHUB_TYPES, F.concat(F.lit("github."), action))
    ms = F.coalesce(F.col("`@timestamp`").cast("bigint"), F.lit(0))
    clone, token = kind == "github.repository.clone", kind == "github.token.create"
    attributes = variants(repository=F.when(clone, F.col("repo")), repository_sensitivity=F.when(clone, F.coalesce("repository_visibility", F.lit("normal"))), token_name=F.when(token, F.col("token_name")), scopes=F.when(token, F.col("scopes")))
    event_id = text_or(F.col("_document_id"), F.concat(F.lit("gh-"), ms.cast("string"), F.lit("-"), F.coalesce("actor", F.lit("None"))))
    return _events(raw, event_id, kind, ms * 1000, "github_audit", "github", F.col("_document_id"), attributes, {"user_id": F.col("actor"), "email": F.col("actor_email")})


def from_cloudtrail(raw: DataFrame) -> DataFrame:
    """Trail records: eventID, eventName, eventTime (ISO), awsRegion, userIdentity{...}, requestParameters{bucketName, key, userName}."""
    name = F.coalesce(F.col("eventName"), F.lit(""))
    kind = named(name, CLOUDTRAIL_TYPES, F.concat(F.lit("aws."), F.lower(name)))
    who, what = F.col("userIdentity"), F.col("requestParameters")
    read, user = kind == "aws.s3.get_object", kind.isin("iam.user.create", "iam.user.delete")
    attributes = variants(aws_region=F.col("awsRegion"), bucket=F.when(read, what["bucketName"]), key=F.when(read, what["key"]), target_user=F.when(user, what["userName"]))
    event_id = text_or(F.col("eventID"), F.concat(F.lit("ct-"), F.col("eventTime")))
    return _events(raw, event_id, kind, iso_micros(F.col("eventTime")), "cloudtrail", "cloudtrail", F.col("eventID"), attributes, {"user_id": text_or(who["userName"], who["principalId"]), "source_identity": who["arn"]})


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table: attributes value, k (props.$.k) and hi_k (k from 50 on); arrival is observed, then id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("us", micros_of(F.col("ts")))
    source = F.when(F.col("event_type").isin("click", "view"), "web").when(F.col("event_type").isin("purchase", "signup"), "app").otherwise("monitor")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("us").alias("event_us"), (F.col("us") + F.pmod(F.col("event_id") * 7919, F.lit(600)) * 1_000_000).alias("observed_us"),
        struct_of(ACTOR, user_id=F.col("user_id").cast("string")).alias("actor"), struct_of(DEVICE, id=F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")), enrolled=F.col("event_id") % 2 == 0).alias("device"),
        variants(value=F.col("value"), k=F.col("k"), hi_k=F.when(F.col("k") >= 50, F.col("k")), name=F.col("event_type")).alias("attributes"),
        struct_of(PROVENANCE, source=source, confidence=F.lit(1.0)).alias("provenance"),
    )
