"""Version numbers and upgrade paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lines that an upgrade stops at, in order.
UPGRADE_LINES = ("3.10", "4.4", "5.4", "6.1")
#: The language version that each line needs.
NEEDS = {"4.4": "7.2.5", "5.4": "8.1", "6.1": "8.3"}


def parts(version: Column) -> Column:
    """Up to four numbers of a version; arrays compare as versions do."""
    return F.slice(F.transform(F.regexp_extract_all(version, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("int")), 1, 4)


def major(version: Column) -> Column:
    return F.get(parts(version), F.lit(0))


def line(version: Column) -> Column:
    """Major and minor number, or null."""
    return F.nullif(F.regexp_extract(version, "^(\\d+\\.\\d+)", 1), F.lit(""))


def at_least(version: Column, wanted: Column) -> Column:
    return F.when(F.size(parts(version)) > 0, parts(version) >= parts(wanted))


def launch_line(version: Column) -> Column:
    """The line that a version belongs to: its own, or that of its major number; null where unreadable or unknown."""
    lines = F.array(*(F.lit(x) for x in UPGRADE_LINES))
    same_major = F.get(F.filter(lines, lambda x: major(x) == major(version)), F.lit(0))
    return F.when(line(version).isNotNull(), F.when(F.array_contains(lines, line(version)), line(version)).otherwise(same_major))


def hops(version: Column) -> Column:
    """Lines still to pass, in order: a version behind its own line passes that first; null where the line is unknown."""
    lines = F.array(*(F.lit(x) for x in UPGRADE_LINES))
    at = F.array_position(lines, launch_line(version))
    begin = at + F.when(line(version) == launch_line(version), 1).otherwise(0)
    return F.when(at > 0, F.filter(lines, lambda x, i: i + 1 >= begin))
