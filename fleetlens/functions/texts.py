"""Column helpers for text and decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.times import col


def anchor(c: Column | str) -> Column:
    """Without the characters that an anchor name may not have."""
    return F.translate(col(c), " `:-,()/\\%#", "")


def shorten(c: Column | str, most: int) -> Column:
    """Cut to most characters with a mark, then < and > escaped."""
    x = F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("[...]"))).otherwise(col(c))
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def platform_path(path: Column | str, platform: Column | str) -> Column:
    """Separators of the platform: / on linux, \\ elsewhere."""
    return F.when(F.lower(col(platform)) == "linux", F.replace(col(path), F.lit("\\"), F.lit("/"))).otherwise(F.replace(col(path), F.lit("/"), F.lit("\\")))


def major_version(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("."), F.lit(1)).try_cast("int")


def between(c: Column | str, start: str, end: str) -> Column:
    """Text between the first start and the next end; null without them."""
    found = F.regexp_extract(col(c), f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E", 1)
    return F.when(col(c).contains(start) & (found != ""), found)


def two_part_name(c: Column | str) -> tuple[Column, Column]:
    """Schema and table of [schema].[table]."""
    pattern = r"^\[(.*?)\]\.\[(.*?)\]$"
    return F.regexp_extract(col(c), pattern, 1), F.regexp_extract(col(c), pattern, 2)


def undashed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^--", "")


def decode(c: Column | str, names: dict, default: str | None = "Unknown") -> Column:
    """names[c], else default."""
    out = F.lit(default).cast("string")
    for k, v in reversed(names.items()):
        out = F.when(col(c) == k, v).otherwise(out)
    return out


#: Codes of the telemetry tables.
QUEUE_STATUS = {-1: "Not executed", 0: "Failed", 1: "Succeded", 2: "Retry", 3: "Canceled", 4: "In progress"}
EVENT_TYPE = {0: "info", 1: "alert", 2: "job-history", 3: "report-html", 4: "action", 5: "backup-job-history", 6: "alert-custom"}
OS_LOG = {1: "Application", 2: "System", 3: "Setup"}
OS_LEVEL = {1: "Critical", 2: "Error", 3: "Warning", 4: "Information"}
SUBJECT = {0: "info", 1: "alert", 2: "job status", 3: "report", 4: "action", 5: "job status", 6: "alert"}
RECOVERY_MODEL = {1: "FULL", 2: "BULK_LOGGED", 3: "SIMPLE"}
PAGE_VERIFY = {0: "NONE", 1: "TORN_PAGE_DETECTION", 2: "CHECKSUM"}
WEEKDAY_BITS = {1: "Sunday", 2: "Monday", 4: "Tuesday", 8: "Wednesday", 16: "Thursday", 32: "Friday", 64: "Saturday"}
FREQUENCY = {1: "Once", 4: "Daily", 8: "Weekly", 16: "Monthly", 32: "Monthly - Relative to Frequency Interval", 64: "At agent startup", 128: "At idle"}


def weekdays(mask: Column | str) -> Column:
    """Names of the days whose bits are set, Sunday first."""
    return F.concat_ws(", ", *(F.when(col(mask).bitwiseAND(bit) != 0, name) for bit, name in WEEKDAY_BITS.items()))
