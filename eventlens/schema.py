"""Canonical audit-event schema, display labels and presentation defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import LongType, StringType, StructField, StructType

# ---------------------------------------------------------------------------
# These must equal the audited application's for identical
# results (column names, labels, orders, hidden set, limits).
# ---------------------------------------------------------------------------

KNOWN_COLUMNS = [
    "uuid",
    "deduplicationId",
    "timestamp",
    "filename",
    "projectId",
    "projectName",
    "userId",
    "username",
    "hardwareTierId",
    "environmentName",
    "workspaceName",
    "action",
]

OPTIONAL_COLUMNS = ["environmentRevisionNumber", "workspaceId"]

COLUMN_LABELS = {
    "timestamp": "Date & Time (UTC)",
    "username": "User Name",
    "action": "Event",
    "filename": "File Path",
    "projectName": "Project Name",
    "workspaceName": "Workspace Name",
    "environmentName": "Environment Name",
    "environmentRevisionNumber": "Environment Revision Number",
    "hardwareTierId": "Hardware Tier ID",
    "projectId": "Project ID",
    "workspaceId": "Workspace ID",
    "userId": "User ID",
    "uuid": "UUID",
    "deduplicationId": "Deduplication ID",
}

TABLE_COLUMN_ORDER = [
    "timestamp",
    "username",
    "action",
    "filename",
    "projectName",
    "projectId",
    "workspaceName",
    "workspaceId",
    "environmentName",
    "environmentRevisionNumber",
    "hardwareTierId",
]

HIDDEN_COLUMNS = ["userId", "uuid", "deduplicationId"]

FILTER_EXCLUDE_COLUMNS = [
    "uuid",
    "deduplicationId",
    "timestamp",
    "projectId",
    "userId",
    "workspaceName",
    "environmentName",
    "hardwareTierId",
]

FILTER_SECTIONS = {
    "section1": ["action", "username", "projectName", "workspaceName", "filename"],
    "section2": ["environmentName", "hardwareTierId"],
}

DEFAULT_PAGE_SIZE = 100
DEFAULT_SORT_COLUMN = "timestamp"
DEFAULT_SORT_ORDER = "DESC"
TOP_N_VALUES = 10
FACET_VALUE_CAP = 1000
UNKNOWN_LABEL = "Unknown"
OTHER_LABEL = "Other"
TIME_COLUMN = "timestamp"

# Chart bucket width by range length in whole days: <= 1 hour, <= 60 day,
# <= 365 week, longer month. Weeks start on Sunday.
BUCKET_MAX_DAYS = {"hour": 1, "day": 60, "week": 365}

# Bucket keys (Spark datetime patterns).
BUCKET_LABEL_FORMATS = {
    "hour": "yyyy-MM-dd HH:00",
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM",
}

DISPLAY_TIME_FORMAT = "MM/dd/yyyy, HH:mm:ss"
REFRESH_TIME_FORMAT = "MMM d, yyyy - h:mm a"
ELLIPSIS_AT = 30
EXPORT_PREFIX = "workspace_audit_events"

# ---------------------------------------------------------------------------

EVENT_SCHEMA = StructType(
    [
        StructField(
            c,
            LongType() if c == TIME_COLUMN else StringType(),
            nullable=c not in ("uuid", TIME_COLUMN),
        )
        for c in KNOWN_COLUMNS
    ]
)


@dataclass(frozen=True)
class ViewConfig:
    """Presentation defaults: which columns a UI filters, shows and hides."""

    page_size: int = DEFAULT_PAGE_SIZE
    sort_column: str = DEFAULT_SORT_COLUMN
    sort_order: str = DEFAULT_SORT_ORDER
    top_n: int = TOP_N_VALUES
    facet_cap: int = FACET_VALUE_CAP
    hidden_columns: tuple[str, ...] = tuple(HIDDEN_COLUMNS)
    column_order: tuple[str, ...] = tuple(TABLE_COLUMN_ORDER)
    filter_exclude: tuple[str, ...] = tuple(FILTER_EXCLUDE_COLUMNS)
    labels: dict[str, str] = field(default_factory=lambda: dict(COLUMN_LABELS))

    def filterable(self, columns: list[str]) -> list[str]:
        """Columns a filter panel offers: the two sections minus exclusions."""
        wanted = FILTER_SECTIONS["section1"] + FILTER_SECTIONS["section2"]
        return [c for c in wanted if c in columns and c not in self.filter_exclude]

    def breakdown_fields(self, columns: list[str]) -> list[str]:
        """Fields a chart breakdown offers (same subset as the filter panel's first section)."""
        return [
            c
            for c in FILTER_SECTIONS["section1"]
            if c in columns and c not in self.filter_exclude
        ]


DEFAULT_VIEW = ViewConfig()
