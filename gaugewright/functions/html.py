"""Facts of HTML pages. Regular parts are Column expressions; JSON-LD trees need one Arrow UDF."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ENTITIES, cap_ends, html_text, squeeze, strip_tags, word_count


def title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, level: int) -> Column:
    """Texts of the headings of one level, empty ones dropped."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<h{level}\\b[^>]*>(.*?)</h{level}>"), F.lit(1))
    return F.filter(F.transform(found, strip_tags), lambda x: x != "")


def heading_levels(html: Column) -> Column:
    """Levels of all headings in document order."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<h([1-6])\\b[^>]*>.*?</h\\1>"), F.lit(1)), lambda x: x.cast("int"))


def skips_level(levels: Column) -> Column:
    """Does a heading follow one that is more than a level higher?"""
    return F.exists(F.zip_with(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), levels, lambda b, a: b - a > 1), lambda x: F.coalesce(x, F.lit(False)))


def meta(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, f'(?is)<meta\\s[^>]*name="{name}"[^>]*>', 0)
    return F.nullif(F.regexp_extract(tag, '(?is)content="([^"]*)"', 1), F.lit(""))


def canonical(html: Column) -> Column:
    tag = F.regexp_extract(html, '(?is)<link\\s[^>]*rel="canonical"[^>]*>', 0)
    return F.nullif(F.regexp_extract(tag, '(?is)href="([^"]*)"', 1), F.lit(""))


def body_text(html: Column) -> Column:
    return strip_tags(F.regexp_replace(html, "(?is)<head\\b.*?</head>", " "))


#: Elements that are no main text, by name; by words of an id that begins with SECTION; by words of a class.
ASIDES = ("header", "nav", "footer", "aside")
SECTION = "shopify-section-"
SECTION_WORDS = ("header", "footer", "announcement", "cart", "drawer", "popup", "newsletter", "menu")
HIDDEN_WORDS = ("visually-hidden", "visuallyhidden", "sr-only", "screen-reader", "skip-to-content")
#: Phrases that themes repeat on every page; # stands for a number.
REPEATED = (
    "Skip to content", "Skip to product information", "Skip to information", "Open media # in modal", "Play video", "# / of #", "#% (#)", "Be the first to write a review", "Write a review", "Share Share Link Close share Copy link",
    "View full details",
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)\b([^>]*)>")
_NAMED = re.compile(r"""\b(id|class)\s*=\s*"([^"]*)\"""")


def _is_aside(name: str, attributes: str) -> bool:
    if name in ASIDES:
        return True
    given = {k: v.lower() for k, v in _NAMED.findall(attributes.lower())}
    section = given.get("id", "")
    return (section.startswith(SECTION) and any(w in section for w in SECTION_WORDS)) or any(w in given.get("class", "") for w in HIDDEN_WORDS)


def main_region(page: str) -> str:
    """What a page shows as its own: inside the first <main> if there is one, without asides.

    Tags are read once, in order. A stack for each element's name pairs every end with the begin of its depth, so an element
    goes with all it holds, further elements of its name too; one without an end loses its tag only.
    """
    tags = [(m.start(), m.end(), bool(m[1]), m[2].lower(), m[3]) for m in _TAG.finditer(page)]
    low, high = 0, len(page)
    if begin := next((t for t in tags if t[3] == "main" and not t[2]), None):
        if end := next((t for t in tags if t[3] == "main" and t[2] and t[0] >= begin[1]), None):
            low, high = begin[1], end[0]
    stacks: dict[str, list[tuple[int, bool]]] = {}
    spans = []
    for start, stop, closes, name, attributes in tags:
        if not low <= start < high:
            continue
        if not closes:
            stacks.setdefault(name, []).append((start, _is_aside(name, attributes)))
        elif stacks.get(name):
            begun, aside = stacks[name].pop()
            if aside:
                spans.append((begun, stop))
    out, at = [], low
    for begun, stop in sorted(spans):
        if stop > at:
            out += [page[at : max(at, begun)], " "]
            at = stop
    return "".join(out) + page[at:high]


#: How many pages of a batch stand in Python at once.
PAGES_AT_ONCE = 64


def _main_regions(pages: pa.Array) -> pa.Array:
    some = (pages.slice(at, PAGES_AT_ONCE) for at in range(0, max(len(pages), 1), PAGES_AT_ONCE))
    return pa.concat_arrays([pa.array([None if p is None else main_region(p) for p in part.to_pylist()], pa.string()) for part in some])


def main_text(html: Column, cap: int = 8000) -> Column:
    """Text of a page's main region, without what themes repeat, its head and tail if it is longer than ``cap``; empty for none."""
    text = html_text(F.arrow_udf(_main_regions, "string")(F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1>", " ")), 1 << 30)
    for phrase in REPEATED:
        pattern = re.sub(r"\\?#", r"\\d+", re.escape(phrase))
        text = F.regexp_replace(text, ("\\b" if phrase[-1] == ")" else "(?i)\\b") + pattern + ("" if phrase[-1] == ")" else "\\b"), " ")
    return cap_ends(squeeze(text), cap)


def arrival(html: Column) -> Column:
    """'received', or why a page did not arrive: bot-wall, js-shell or empty."""
    text = body_text(html)
    bare = (F.length(text) < 200) & (F.regexp_count(html, F.lit("(?i)<h[1-3]\\b")) == 0) & (F.regexp_count(html, F.lit("(?i)<a\\s")) <= 2)
    wall = F.regexp_like(html, F.lit("(?i)captcha|access denied|verify you are human"))
    return F.when(~bare, "received").when(wall, "bot-wall").when(F.length(html) > 2000, "js-shell").otherwise("empty")


def _json_ld_nodes(html: pd.Series, wanted: frozenset[str] | None = None) -> pd.Series:
    """All object nodes of a page's JSON-LD, parents first; blocks that do not parse are skipped. Only nodes of a wanted type are written out."""
    blocks = re.compile(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>')

    def walk(node, depth: int, out: list) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x, depth, out)
        elif isinstance(node, dict):
            kinds = node.get("@type")
            kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
            name = node.get("name")
            out.append({"depth": depth, "types": kinds, "name": name if isinstance(name, str) else None, "node": json.dumps(node, ensure_ascii=False) if wanted is None or not wanted.isdisjoint(kinds) else None})
            for key, x in node.items():
                if key != "@context":
                    walk(x, depth + 1, out)

    def one(page: str | None) -> list:
        out: list = []
        for block in blocks.findall(page or ""):
            try:
                walk(json.loads(block), 0, out)
            except ValueError:
                continue
        return out

    return html.map(one)


def json_ld(html: Column, kinds: Iterable[str] | None = None) -> Column:
    """Array of the object nodes of a page's JSON-LD: depth, types, name and the node itself as JSON, null for types not among ``kinds`` if these are given."""
    wanted = None if kinds is None else frozenset(kinds)

    def nodes(page: pd.Series) -> pd.Series:
        return _json_ld_nodes(page, wanted)

    return F.pandas_udf(nodes, "array<struct<depth int, types array<string>, name string, node string>>")(html)


def page_facts(pages):
    """pages(url, html) with the columns that the checks read."""
    text = body_text(F.col("html"))
    return (
        pages.withColumn("title", title(F.col("html")))
        .withColumn("text", text)
        .withColumn("word_count", word_count(F.col("text")))
        .withColumn("meta_description", meta(F.col("html"), "description"))
        .withColumn("canonical", canonical(F.col("html")))
        .withColumn("content_hash", F.sha1(F.col("text").cast("binary")))
    )


#: Headings that introduce no content of their own.
BARE_HEADINGS = ("follow us:",)
#: What a heading needs at least to carry a block.
LEAST_HEADING = 8


def heading_pairs(html: Column, least: int = LEAST_HEADING, entities: Iterable[str] = tuple(ENTITIES)) -> Column:
    """Array of (heading, body): each heading of a fragment with the paragraph right after it, empty if none follows; short headings are left out.

    ``entities`` are those that are decoded; others stay as they are written.
    """
    shape = "(?is)<h([1-6])[^>]*>(.*?)</h\\1>\\s*(?:<p[^>]*>(.*?)</p>)?"
    plain = lambda x: squeeze(decode_entities(F.regexp_replace(x, "<[^>]+>", " "), entities))
    pairs = F.transform(F.regexp_extract_all(html, F.lit(shape), F.lit(0)), lambda x: F.struct(plain(F.regexp_extract(x, shape, 2)).alias("heading"), plain(F.regexp_extract(x, shape, 3)).alias("body")))
    return F.filter(pairs, lambda p: (F.char_length(p["heading"]) >= least) & ~F.lower(p["heading"]).isin(*BARE_HEADINGS))


def decode_entities(text: Column, entities: Iterable[str] = tuple(ENTITIES)) -> Column:
    """Text with those of the six entities decoded that stay text; &amp; last, so that nothing is decoded twice."""
    for entity in sorted(entities, key="&amp;".__eq__):
        text = F.replace(text, F.lit(entity), F.lit(ENTITIES[entity]))
    return text
