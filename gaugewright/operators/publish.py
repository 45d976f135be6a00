"""Sinks: snapshots, envelopes and statements."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import tier


def snapshot(rows: DataFrame, folder: str, search: list[str], partition: str | None = None) -> None:
    """Replace a published folder: all columns under index, a narrow projection under search."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(f"{folder}/index")
    rows.select(*search).write.mode("overwrite").json(f"{folder}/search")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put in or replaced by key; rows of one key must be one."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows put in whose key it lacks."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def restored(table: DataFrame, ident: str, offset: int) -> DataFrame:
    """The table without what was added from an id on."""
    return table.where(F.col(ident) < offset)


def envelope(kind: str, label: str, findings: Column, unavailable: Column) -> Column:
    """One JSON envelope: parts that could not be read are named, and are not an error."""
    status = F.when(F.size(unavailable) > 0, "partial").otherwise("ok")
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), status.alias("status"), findings.alias("findings"), unavailable.alias("unavailable")))


def quoted(value: Column) -> Column:
    """SQL literal of a string."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def insert_statement(table: str, columns: list[str]) -> Column:
    """INSERT statement of a row; numbers stay bare by being cast before."""
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *(quoted(F.col(c).cast("string")) for c in columns)), F.lit(");"))


#: JSON Schema types of Spark's types; whole and real numbers by family.
_JSON_TYPES = {"string": "string", "boolean": "boolean", "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number", "decimal": "number"}


def _described(kind: T.DataType, given: dict) -> dict:
    if isinstance(kind, T.StructType):
        parts = {f.name: _described(f.dataType, f.metadata) for f in kind}
        needed = [f.name for f in kind if not f.nullable and "default" not in f.metadata]
        return {"type": "object", "properties": parts} | ({"required": needed} if needed else {}) | {"additionalProperties": False} | _noted(given)
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _described(kind.elementType, {})} | _noted(given)
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _described(kind.valueType, {})} | _noted(given)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date" if isinstance(kind, T.DateType) else "date-time"} | _noted(given)
    return {"type": _JSON_TYPES[kind.typeName()]} | _noted(given)


def _noted(metadata: dict) -> dict:
    return {k: metadata[k] for k in ("enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "format", "default", "description") if k in metadata}


def json_schema(schema: T.StructType, title: str) -> str:
    """JSON Schema of the records that a table's schema admits, as whoever writes them sees it.

    Fields that are not nullable are required, unless their metadata give a default: these are filled in on reading, so a
    writer may leave them out. Metadata named as JSON Schema's own words (enum, pattern, bounds, default, description) pass on.
    """
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | _described(schema, {}), indent=2, ensure_ascii=False) + "\n"


def reports(rows: DataFrame, audit: str, subject: Column, at: Column, top: int = 3) -> DataFrame:
    """rows(audit, key, factor, status, score, global_weight, ordinal) -> (audit, payload, summary): a JSON report and a short Markdown one an audit.

    The payload holds meta and audit: the weighted score over what was scored (null, and unrated, if nothing was), coverage by
    status, all criteria in their order, and the ``top`` keys that would gain most. A report has as many rows as there are criteria.
    """
    c = F.col
    scored = F.sum(F.when(c("status") == "scored", c("global_weight")))
    gained = F.sum(F.when(c("status") == "scored", c("global_weight") * c("score")))
    loss = F.when(c("status") == "scored", c("global_weight") * (100 - c("score")))
    each = F.struct("ordinal", "key", "factor", "status", "score", F.round("global_weight", 6).alias("weight"))
    worst = F.slice(F.transform(F.array_sort(F.collect_list(F.when(loss > 0, F.struct((-F.round(loss, 9)).alias("loss"), "ordinal", "key")))), lambda x: x["key"]), 1, top)
    count = lambda s: F.count_if(c("status") == s).alias(s)
    one = rows.groupBy(audit).agg(F.round(gained / scored, 1).alias("score"), F.array_sort(F.collect_list(each)).alias("criteria"), worst.alias("top"), F.count("*").alias("total"), count("scored"), count("na"), count("inactive"), F.first(subject).alias("subject"), F.first(at).alias("at"))
    verdict = F.when(c("score").isNull(), None).otherwise(tier(c("score")))
    coverage = F.struct("total", "scored", "na", "inactive")
    held = F.struct("subject", "score", verdict.alias("verdict"), coverage.alias("coverage"), c("top").alias("topPriorities"), F.transform("criteria", lambda x: F.struct(x["key"].alias("key"), x["factor"].alias("factor"), x["status"].alias("status"), x["score"].alias("score"), x["weight"].alias("weight"))).alias("criteria"))
    payload = F.to_json(F.struct(F.struct(c("at").alias("generatedAt"), F.lit("default").alias("template")).alias("meta"), held.alias("audit")), {"ignoreNullFields": "false"})
    said = F.concat(
        F.lit("# Website audit: "), "subject", F.lit("\n\n"), F.coalesce(F.concat(F.lit("Score "), c("score").cast("string"), F.lit(" ("), verdict, F.lit(")")), F.lit("No score: nothing was measured")), F.lit(". "), c("scored").cast("string"), F.lit(" of "), c("total").cast("string"), F.lit(" criteria scored.\n"),
        F.array_join(F.transform("top", lambda x: F.concat(F.lit("\n- "), x)), ""),
    )
    return one.select(audit, payload.alias("payload"), said.alias("summary"))
