"""The rules that come with the library, and an older sibling that shows what a regression looks like."""

from __future__ import annotations

from dataclasses import replace

from tidewatch.plans.rules import Absence, Count, Detection, Event, Sequence

# What the rules look for.
DEGRADED = {"stopped", "disabled", "degraded"}
RESTRICTED_CLONE = Event("github.repository.clone").where(repository_sensitivity="restricted", access_is_first_seen=True)
STAGING = [Event("process.execution").where(process_name__in={"zip", "7z", "tar", "gpg"}), Event("filesystem.write").where(destination_type__in={"removable_media", "cloud_sync_folder"}), Event("security.telemetry_state").where(state__in=DEGRADED)]
RESTRICTED_OBJECT = Event("aws.s3.get_object").where(object_is_restricted=True)
APPROVED = (Absence(Event("change_management.approval").where(approval_status="approved"), "24h"),)

COLLECTION = Detection(
    "TW-IR-0042", "Restricted repositories collected, then staged", Sequence("45m", [Count(RESTRICTED_CLONE, 8, "15m"), *STAGING]), "critical", ("actor.user_id", "device.id"), APPROVED,
    description="First-ever clones in bulk, an archive, removable media and less telemetry, without an approved change.", tags=("insider-risk", "exfiltration", "T1567", "T1560"),
)
TOKEN_ABUSE = Detection(
    "TW-CC-0017", "New token used from unusual infrastructure to list and pull cloud data",
    Sequence("30m", [Event("github.token.create"), Event("identity.authentication").where(infrastructure_is_unusual=True), Count(Event("github.repository.clone"), 5, "10m"), RESTRICTED_OBJECT]), "high",
    description="A token is made, used from elsewhere, repositories are listed and an object is retrieved.", tags=("credential-compromise", "T1078", "T1530"),
)
OFF_HOURS = Detection(
    "TW-TT-0009", "Logging disabled off hours with a temporary privileged identity",
    Sequence("60m", [
        Event("identity.authentication").where(outside_maintenance_window=True, device_is_first_seen=True), Event("security.telemetry_state").where(state__in=DEGRADED, telemetry_source__in={"audit", "logging", "cloudtrail"}),
        Event("iam.user.create").where(privileged=True), RESTRICTED_OBJECT, Event("iam.user.delete").where(privileged=True),
    ]), "critical", exceptions=APPROVED, description="An administrator acts off hours from an unseen device and covers the trail.", tags=("telemetry-tampering", "privilege-abuse", "T1562", "T1078.004"),
)

DETECTIONS = [COLLECTION, OFF_HOURS, TOKEN_ABUSE]

#: Not in the pack: it asks for a classification that most clones lack, so it stops firing (see lab.rule_diff).
_COLLECTION_V2 = replace(COLLECTION, version="2", sequence=Sequence("45m", [Count(Event("github.repository.clone").where(file_sensitivity="restricted", access_is_first_seen=True), 8, "15m"), *STAGING]))
