"""Version strings as comparable parts, codes and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Segment name, lowest major (inclusive), highest major (exclusive).
RELEASE_SEGMENTS = (("latest", 7, None), ("current", 6, 7), ("older", 5, 6), ("legacy", None, 5))
DASHBOARD_SEGMENTS = (("Latest", 11, None), ("Current", 10, 11), ("Older", 8, 10))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def version_part(version: Column | str, position: int) -> Column:
    """Integer at a 1-based dotted position; null when absent, unknown or not a number."""
    version = _col(version)
    part = F.try_element_at(F.split(version, r"\."), F.lit(position))
    return F.when(version != UNKNOWN, part.try_cast("int"))


def version_parts(version: Column | str = "version") -> dict[str, Column]:
    return {
        "major_version": version_part(version, 1),
        "minor_version": version_part(version, 2),
        "patch_version": version_part(version, 3),
    }


def major_label(version: Column | str = "version") -> Column:
    """First dotted part as text, ``Unknown`` without a dot."""
    version = _col(version)
    return F.when(version.contains("."), F.split(version, r"\.")[0]).otherwise(F.lit(UNKNOWN))


def version_code(version: Column | str) -> Column:
    """``major*10000 + minor*100 + patch``, missing parts 0, further parts ignored.

    Null unless every part is a number.
    """
    version = _col(version)
    numeric = version.rlike(r"^\d+(\.\d+)*$")
    parts = [F.coalesce(version_part(version, i), F.lit(0)) for i in (2, 3)]
    return F.when(numeric, version_part(version, 1) * 10000 + parts[0] * 100 + parts[1])


def literal_code(version: str) -> int:
    major, minor, patch = ([int(p) for p in version.split(".")] + [0, 0])[:3]
    return major * 10000 + minor * 100 + patch


def in_version_range(version: Column | str, low: str, high: str) -> Column:
    """``low <= version < high`` by code; false for unknown or non-numeric versions."""
    code = version_code(version)
    return F.coalesce(
        (code >= literal_code(low)) & (code < literal_code(high)), F.lit(False)
    )


def version_segment(
    version: Column | str = "version",
    segments=RELEASE_SEGMENTS,
) -> Column:
    """Segment name by major version; ``Unknown`` stays so, anything else is null."""
    version = _col(version)
    major = version_part(version, 1)
    out = F.when(version == UNKNOWN, UNKNOWN)
    for name, low, high in segments:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (major >= low)
        if high is not None:
            inside = inside & (major < high)
        out = out.when(major.isNotNull() & inside, name)
    return out
