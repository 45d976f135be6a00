"""Database extracts as delimited lines, and back. Fields that may hold anything are kept in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_of(fields: dict[str, Column], encoded: set[str] = frozenset(), separator: str = "|") -> Column:
    """One line for a row: encoded fields in base64 without breaks; in others separators become / and line breaks a blank; null is \\N."""
    parts = []
    for name, value in fields.items():
        text = value.cast("string")
        plain = F.regexp_replace(F.replace(text, F.lit(separator), F.lit("/")), "[\\r\\n]+", " ")
        parts.append(F.coalesce(F.regexp_replace(F.base64(text.cast("binary")), "[\\r\\n]", "") if name in encoded else plain, F.lit("\\N")))
    return F.concat_ws(separator, *parts)


def rows_of(lines: DataFrame, fields: str, encoded: set[str] = frozenset(), separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """lines(value, ...) -> (rows, rejected): rows with ``fields``, a DDL schema, cast from the parts of each line; other columns stay.

    Rejected lines come with a ``reason``: too few or too many fields, a field that is no base64 of UTF-8, or one that does not
    cast. \\N is null everywhere, an empty part is an empty string, or null for other types. Blank lines are passed over.
    """
    schema = lines.sparkSession.createDataFrame([], fields).schema
    parts = lines.where("trim(value) <> ''").withColumn("_parts", F.split("value", f"\\Q{separator}\\E", -1))
    out, reasons = {}, [F.when(F.size("_parts") < len(schema), F.lit("too few fields")).when(F.size("_parts") > len(schema), F.lit("too many fields"))]
    for at, field in enumerate(schema):
        raw = F.nullif(F.get("_parts", F.lit(at)), F.lit("\\N"))
        if field.name in encoded:
            held = F.expr("try_to_binary(x, 'base64')".replace("x", f"nullif(get(_parts, {at}), '\\\\\\\\N')"))
            decoded = F.try_validate_utf8(held.cast("string"))
            reasons.append(F.when(raw.isNotNull() & decoded.isNull(), F.lit(f"{field.name} is no base64 of text")))
            raw = decoded
        if field.dataType.simpleString() == "string":
            out[field.name] = raw
        else:
            raw = F.nullif(F.trim(raw), F.lit(""))
            out[field.name] = raw.try_cast(field.dataType)
            reasons.append(F.when(raw.isNotNull() & out[field.name].isNull(), F.lit(f"{field.name} is no {field.dataType.simpleString()}")))
    judged = parts.withColumn("_reason", F.coalesce(*reasons))
    rest = [c for c in lines.columns if c != "value"]
    rows = judged.where("_reason is null").select(*rest, *(c.alias(n) for n, c in out.items()))
    return rows, judged.where("_reason is not null").select(*rest, "value", F.col("_reason").alias("reason"))
