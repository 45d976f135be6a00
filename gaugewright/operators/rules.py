"""Validation rules: named predicates that give violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, code) of every rule that a row breaks; a rule that cannot be judged is not broken."""
    broken = F.filter(F.array(*(F.when(fails, F.lit(code)) for code, fails in rules.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("code"))


def record_rules() -> dict[str, Column]:
    """Rules of a registry record (namespace, path, run_minutes, auto_install, label)."""
    c = F.col
    return {
        "bad-namespace": ~F.regexp_like(c("namespace"), F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")) | (F.length("namespace") > 64),
        "unsafe-path": ~urls.is_safe_path(c("path")),
        "bad-minutes": ~c("run_minutes").between(1, 120),
        "label-required": c("auto_install") & c("label").isNull(),
    }


def resolved_tier(tier: Column, reviewed_hash: Column, content_hash: Column) -> tuple[Column, Column]:
    """Tier that holds, and whether it was demoted: quarantine stays, a curated text that changed is only listed."""
    changed = F.coalesce((tier == "curated") & ~reviewed_hash.eqNullSafe(content_hash), F.lit(False))
    return F.when(tier.isNull() | changed, "listed").otherwise(tier), changed
