"""Trees of JSON: counts anywhere in them, references rewritten, one tree laid over another."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that state how many items a block takes; these parts anywhere in a key, or the whole key.
COUNT_PARTS = ("featured_leading", "featured_intro", "featured_links", "[count]", "num_leading", "num_intro")
COUNT_KEY = "count"
#: Parts of keys that name a category.
CATEGORY_PARTS = ("catid", "categor")


def item_counts(rows: DataFrame, key: str, body: str, cap: int = 24, depth: int = 8) -> DataFrame:
    """rows(key, body) -> (key, items long): what a JSON document asks for in all, summed over the count keys anywhere in it.

    Values of a count key, or each of a list of them, count as whole numbers up to ``cap`` each; other values count nothing.
    Other keys, lists and strings that hold a JSON object are entered, each a level deeper, down to ``depth``. A body that is
    null or no JSON has none. Rows that repeat a key are summed. Each level is one explode of VARIANT; what was counted passes
    on as it is, so levels form a chain, and rows meet once, to be summed.
    """
    name = lambda e: F.lower(e["key"])
    kind = lambda x: F.schema_of_variant(x)
    level = rows.select(key, F.try_parse_json(body).alias("node"), F.lit(False).alias("counted")).where("node is not null")
    for _ in range(depth + 1):
        held = F.expr("try_parse_json(if(startswith(ltrim(try_variant_get(node, '$', 'string')), '{'), try_variant_get(node, '$', 'string'), null))")
        member = lambda x: F.struct(x.alias("node"), F.lit(False).alias("counted"))
        named = lambda e: F.struct(e["value"].alias("node"), (F.exists(F.array(*map(F.lit, COUNT_PARTS)), lambda p: name(e).contains(p)) | (name(e) == COUNT_KEY)).alias("counted"))
        parts = (
            F.when(F.col("counted"), F.array(F.struct("node", "counted")))
            .when(kind("node").startswith("OBJECT"), F.transform(F.map_entries(F.expr("try_variant_get(node, '$', 'map<string, variant>')")), named))
            .when(kind("node").startswith("ARRAY"), F.transform(F.expr("try_variant_get(node, '$', 'array<variant>')"), member))
            .when((kind("node") == "STRING") & held.isNotNull(), F.array(member(held)))
        )
        level = level.select(key, F.explode(parts).alias("part")).select(key, "part.*")
    single = F.when(kind("node").startswith("ARRAY"), F.expr("try_variant_get(node, '$', 'array<variant>')")).otherwise(F.array("node"))
    items = level.where("counted").select(key, F.explode(single).alias("node"))
    digits = F.when(kind("node").isin("BIGINT", "STRING"), F.trim(F.expr("try_variant_get(node, '$', 'string')")))
    number = F.when(F.regexp_like(digits, F.lit("^[+-]?[0-9]+$")), F.least(digits.try_cast("decimal(38,0)"), F.lit(cap)).cast("long"))
    sums = items.groupBy(key).agg(F.sum(number).alias("items"))
    return rows.select(key).distinct().join(sums, key, "left").fillna(0, ["items"])


def _paths(tree: Any, lists: bool, at: tuple = ()) -> dict[tuple, Any]:
    """A tree as a map of paths to leaves; empty containers are leaves, and so are lists unless they are entered too."""
    if isinstance(tree, dict) and tree:
        parts = tree.items()
    elif isinstance(tree, list) and tree and lists:
        parts = enumerate(tree)
    else:
        return {at: tree}
    return {path: leaf for part, x in parts for path, leaf in _paths(x, lists, (*at, part)).items()}


def _built(paths: dict[tuple, Any]) -> Any:
    """The tree of a map of paths; places in lists are whole numbers and stand in order."""
    if () in paths:
        return paths[()]
    parts: dict[Any, dict] = {}
    for (first, *rest), leaf in paths.items():
        parts.setdefault(first, {})[tuple(rest)] = leaf
    built = {k: _built(v) for k, v in parts.items()}
    return list(built.values()) if isinstance(next(iter(built)), int) else built


def _compact(tree: Any) -> str:
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


def _object(text: Any) -> dict | None:
    """The object that a string holds, if it holds one."""
    if not isinstance(text, str) or not text.lstrip().startswith("{"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


_CATEGORY = re.compile("|".join(CATEGORY_PARTS), re.IGNORECASE)


def _pointed(tree: Any, target: str) -> Any:
    out: dict[tuple, Any] = {}
    for path, leaf in _paths(tree, lists=True).items():
        cut = next((n for n, part in enumerate(path, 1) if isinstance(part, str) and _CATEGORY.search(part)), None)
        if cut is None:
            held = _object(leaf)
            out[path] = leaf if held is None else _compact(_pointed(held, target))
        else:
            was_list = isinstance(path[cut], int) if cut < len(path) else isinstance(leaf, list)
            out[path[:cut]] = [target] if was_list else target
    return _built(out)


def _pointed_texts(bodies: pa.Array, targets: pa.Array) -> pa.Array:
    out = []
    for body, target in zip(bodies.to_pylist(), targets.to_pylist(), strict=True):
        held = _object(body)
        out.append(None if held is None or target is None else _compact(_pointed(held, target)))
    return pa.array(out, pa.string())


def retargeted(body: Column, target: Column) -> Column:
    """A JSON object with every category reference replaced by ``target``, a list of them by a list of it; null where the body holds no object.

    References inside strings that hold JSON are replaced too. Keys keep their order; the text is compact, letters stay as they are.
    """
    return F.arrow_udf(_pointed_texts, "string")(body, target)


def merged(base: Any, over: Any) -> Any:
    """``over`` laid over ``base``: objects merge by key, anything else is replaced by the later value; ``rows`` of a merged object is the length of its longest list."""
    below, above = _paths(base, lists=False), _paths(over, lists=False)
    inner = {path[:n] for path in below for n in range(len(path))} | {p for p, leaf in below.items() if leaf == {}}
    kept = dict(below)
    for path, leaf in above.items():
        if leaf == {} and path in inner:
            continue
        for n in range(len(path)):
            kept.pop(path[:n], None)  # a value, or an empty object, that is entered now
        if path in inner:
            kept = {p: x for p, x in kept.items() if p[: len(path)] != path}
        kept[path] = leaf
    met = {path[:n] for path in above for n in range(1, len(path) + 1)} & inner & {p[:n] for p in kept for n in range(len(p))}
    for at in met:
        if (*at, "rows") in kept and (lists := [len(x) for p, x in kept.items() if p[:-1] == at and isinstance(x, list)]):
            kept[(*at, "rows")] = max(lists)
    return _built(kept)


def _merged_texts(bases: pa.Array, overs: pa.Array) -> pa.Array:
    pairs = [(_object(a), _object(b)) for a, b in zip(bases.to_pylist(), overs.to_pylist(), strict=True)]
    return pa.array([_compact(merged(a, b)) if a is not None and b is not None else (_compact(a) if a is not None else None) for a, b in pairs], pa.string())


def deep_merged(base: Column, over: Column) -> Column:
    """``merged`` of two JSON objects as compact text; the base alone where there is nothing to lay over it, null where it is no object."""
    return F.arrow_udf(_merged_texts, "string")(base, over)
