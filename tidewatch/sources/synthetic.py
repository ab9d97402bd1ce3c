"""Synthetic telemetry: a small enterprise's benign noise, of any volume, and three incidents laid over it.

Each noise event is a function of the seed and its number alone, so the same call gives the same events on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import micros
from tidewatch.sources.events import ACTOR, DEVICE, PROVENANCE, struct_of, variants

EPOCH_US = 1_770_066_000_000_000  # 2026-02-02 21:00 UTC
MINUTE = 60_000_000
# Kinds of benign events with their weights, types and sources, and the values they draw from.
KINDS = (("login", 2, "identity.authentication", "okta"), ("process", 5, "process.execution", "osquery"), ("clone", 2, "github.repository.clone", "github_audit"), ("dns", 3, "dns.query", "zeek"), ("network", 3, "network.connection", "zeek"), ("sudo", 1, "sudo.command", "auditd"))
PROCESSES = ("git", "python", "node", "bash", "ls", "code")
REPOSITORIES = ("svc-api", "svc-web", "svc-billing", "svc-auth", "svc-infra", "svc-data")
DOMAINS = ("github.com", "pypi.org", "slack.com", "datadog.com")
COMMANDS = ("apt", "systemctl", "docker")


def draw(seed: int, what: str, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the row's number, the seed and what it is for."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(n))


def one_of(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def background_noise(spark: SparkSession, count: int, seed: int = 1337, employees: int = 40, window: object = "240m") -> DataFrame:
    """`count` benign events of `employees` people, each with a device, spread over the window."""
    rows = spark.range(count)
    kinds = tuple(k for k in KINDS for _ in range(k[1]))
    at = draw(seed, "kind", len(kinds))
    kind, person = one_of(tuple(k[0] for k in kinds), at), draw(seed, "person", employees)
    is_ = lambda k: kind == k
    attributes = variants(
        result=F.when(is_("login"), "success"), infrastructure_is_unusual=F.when(is_("login"), F.lit(False)), process_name=F.when(is_("process"), one_of(PROCESSES, draw(seed, "process", len(PROCESSES)))),
        repository=F.when(is_("clone"), one_of(REPOSITORIES, draw(seed, "repository", len(REPOSITORIES)))), repository_sensitivity=F.when(is_("clone"), "normal"), access_is_first_seen=F.when(is_("clone"), F.lit(False)),
        query=F.when(is_("dns"), one_of(DOMAINS, draw(seed, "query", len(DOMAINS)))), bytes_out=F.when(is_("network"), 1000 + draw(seed, "bytes", 199_001)), destination=F.when(is_("network"), "corp-internal"), command=F.when(is_("sudo"), one_of(COMMANDS, draw(seed, "command", len(COMMANDS)))),
    )
    name = F.lpad(person.cast("string"), 3, "0")
    time = F.lit(EPOCH_US) + draw(seed, "time", micros(window))
    source = one_of(tuple(k[3] for k in kinds), at)
    return rows.select(
        F.concat(F.lit("N"), F.lpad((F.col("id") + 1).cast("string"), 6, "0")).alias("event_id"), one_of(tuple(k[2] for k in kinds), at).alias("event_type"), time.alias("event_us"), time.alias("observed_us"),
        struct_of(ACTOR, user_id=F.concat(F.lit("emp"), name)).alias("actor"), struct_of(DEVICE, id=F.concat(F.lit("WS-"), name), enrolled=F.when(~kind.isin("dns", "network"), F.lit(True))).alias("device"),
        attributes.alias("attributes"), struct_of(PROVENANCE, source=source, collector=source, confidence=F.lit(1.0)).alias("provenance"),
    )


def made_events(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Events from (id, type, minutes, source, user, device, enrolled, attributes)."""
    parts = []
    for event_id, kind, minutes, source, user, device, enrolled, attributes in rows:
        us = EPOCH_US + round(minutes * MINUTE)
        parts.append(F.struct(
            F.lit(event_id).alias("event_id"), F.lit(kind).alias("event_type"), F.lit(us).cast("bigint").alias("event_us"), F.lit(us).cast("bigint").alias("observed_us"), struct_of(ACTOR, user_id=F.lit(user)).alias("actor"),
            struct_of(DEVICE, id=F.lit(device), enrolled=F.lit(enrolled)).alias("device"), variants(**{k: F.lit(v) for k, v in attributes.items()}).alias("attributes"), struct_of(PROVENANCE, source=F.lit(source), collector=F.lit(source), confidence=F.lit(1.0)).alias("provenance"),
        ))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*parts)))


def departing_engineer(spark: SparkSession, noise: int = 600) -> DataFrame:
    """First-ever clones of restricted repositories, an archive, removable media, and telemetry that stops."""
    who, host = "jdoe", "WS-JDOE-01"
    rows = [("E1000", "github.token.create", 41, "github_audit", who, host, True, {"token_name": "cli-automation", "scopes": "repo,read:org"})]
    for i in range(19):
        classified = {"file_sensitivity": "restricted"} if i < 6 else {}
        rows.append((f"E{1001 + i}", "github.repository.clone", 64 + i * 11 / 18, "github_audit", who, host, True, {"repository": f"restricted/proj-{i:02d}", "repository_sensitivity": "restricted", "access_is_first_seen": True} | classified))
    rows += [
        ("E1020", "process.execution", 80, "osquery", who, host, True, {"process_name": "gpg", "command_line": "gpg -c collection.tar"}),
        ("E1021", "filesystem.write", 82, "osquery", who, host, True, {"destination_type": "removable_media", "path": "/mnt/usb/collection.tar.gpg", "bytes": 734003200}),
        ("E1022", "security.telemetry_state", 84, "osquery", who, host, True, {"state": "stopped", "telemetry_source": "endpoint"}),
        ("E1023", "filesystem.delete", 86, "osquery", who, host, True, {"path": f"/home/{who}/.bash_history"}),
        ("E1024", "network.connection", 88, "zeek", who, host, None, {"bytes_out": 734003200, "destination": "storage.example-personal.com", "destination_is_first_seen": True}),
    ]
    return background_noise(spark, noise, 42).unionByName(made_events(spark, rows))


def compromised_developer(spark: SparkSession, noise: int = 500) -> DataFrame:
    """A new token used from unusual infrastructure, clones and a restricted object; the person's own device is silent."""
    who, host = "devlee", "vps-203-0-113-9"
    rows = [
        ("C2000", "github.token.create", 8, "github_audit", who, None, None, {"token_name": "ci-deploy", "scopes": "repo"}),
        ("C2001", "identity.authentication", 12, "okta", who, host, False, {"result": "success", "infrastructure_is_unusual": True, "asn": "AS14061", "geo": "unexpected"}),
        *[(f"C{2002 + i}", "github.repository.clone", 14 + i * 0.8, "github_audit", who, host, False, {"repository": f"restricted/svc-{i:02d}", "repository_sensitivity": "restricted", "access_is_first_seen": True}) for i in range(9)],
        ("C2020", "aws.s3.get_object", 24, "cloudtrail", who, None, None, {"bucket": "acme-secrets", "key": "prod/credentials.json", "object_is_restricted": True}),
    ]
    return background_noise(spark, noise, 7).unionByName(made_events(spark, rows))


def privileged_admin(spark: SparkSession, noise: int = 500) -> DataFrame:
    """Off hours, from an unseen device: logging disabled, a temporary identity made, used and deleted; routine work before."""
    who, host = "adminkay", "laptop-personal-kay"
    rows = [(f"A30{i:02d}", "iam.policy.change", 5 + i * 3, "cloudtrail", who, "bastion-01", True, {"within_maintenance_window": True, "change": "attach-policy"}) for i in range(12)]
    rows += [
        ("A4000", "identity.authentication", 150, "okta", who, host, False, {"result": "success", "outside_maintenance_window": True, "device_is_first_seen": True}),
        ("A4001", "security.telemetry_state", 156, "cloudtrail", who, host, None, {"state": "disabled", "telemetry_source": "cloudtrail"}),
        ("A4002", "iam.user.create", 162, "cloudtrail", who, host, None, {"privileged": True, "new_principal": "svc-temp-break-glass"}),
        ("A4003", "aws.s3.get_object", 168, "cloudtrail", who, host, None, {"bucket": "ir-evidence", "key": "cases/2026/restricted.zip", "object_is_restricted": True}),
        ("A4004", "iam.user.delete", 174, "cloudtrail", who, host, None, {"privileged": True, "deleted_principal": "svc-temp-break-glass"}),
    ]
    return background_noise(spark, noise, 99).unionByName(made_events(spark, rows))


# What the kinds of recorded lab actions become: type, source, attributes that are constant, and ones read.
LAB_ACTIONS = {
    "clone": ("github.repository.clone", "github_audit", {"repository_sensitivity": "restricted", "access_is_first_seen": True}, {"repository": ("repo", None)}),
    "archive": ("process.execution", "osquery", {}, {"process_name": ("tool", "tar"), "command_line": ("cmd", None)}),
    "stage": ("filesystem.write", "osquery", {"destination_type": "removable_media"}, {"path": ("path", None)}),
    "telemetry_stop": ("security.telemetry_state", "osquery", {"state": "stopped", "telemetry_source": "endpoint"}, {}),
    "history_delete": ("filesystem.delete", "osquery", {}, {"path": ("path", "~/.bash_history")}),
}


def from_lab_actions(actions: DataFrame, user: str = "lab-user", device: str = "LAB-WS-01") -> DataFrame:
    """Recorded lab actions (line: their number from 0, kind, ts in seconds, repo, tool, cmd, path) as events; other kinds go."""
    parts = []
    for kind, (event_type, source, constant, read) in LAB_ACTIONS.items():
        attributes = variants(**{k: F.lit(v) for k, v in constant.items()}, **{k: F.coalesce(F.col(c), F.lit(other)) for k, (c, other) in read.items()})
        parts.append(actions.where(F.col("kind") == kind).select(
            F.concat(F.lit("LAB"), F.lpad(F.col("line").cast("string"), 4, "0")).alias("event_id"), F.lit(event_type).alias("event_type"), F.round(F.col("ts").cast("double") * 1_000_000).cast("bigint").alias("event_us"), F.lit(None).cast("bigint").alias("observed_us"),
            struct_of(ACTOR, user_id=F.lit(user)).alias("actor"), struct_of(DEVICE, id=F.lit(device), enrolled=F.lit(True)).alias("device"), attributes.alias("attributes"), struct_of(PROVENANCE, source=F.lit(source), confidence=F.lit(1.0)).alias("provenance"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
