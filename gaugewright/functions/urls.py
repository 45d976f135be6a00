"""URL functions as Column expressions. Unparsable URLs give null parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without one leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.split(url, "#")[0]


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")


def depth(url: Column) -> Column:
    return F.size(path_parts(url))


def section(url: Column) -> Column:
    """First path part, or / for the root."""
    return F.coalesce(F.get(path_parts(url), F.lit(0)), F.lit("/"))


def slug(url: Column) -> Column:
    """Name of a site or page for files: scheme out, lower case, other characters one dash, no dash at the ends."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9.-]+|-{2,}", "-"), "^-+|-+$", "")


def is_repository(url: Column) -> Column:
    """https repository URL of one host with exactly owner and name, no port, user, query or fragment."""
    return F.regexp_like(url, F.lit("^https://github\\.com/[^/?#@:\\s]+/[^/?#@:\\s]+/?$"))


def owner(url: Column) -> Column:
    return F.get(path_parts(url), F.lit(0))


def repository(url: Column) -> Column:
    return F.regexp_replace(F.get(path_parts(url), F.lit(1)), "\\.git$", "")


def is_safe_path(path: Column) -> Column:
    """Relative path without drive letter, backslash, NUL or parent parts."""
    return ~F.regexp_like(path, F.lit("^/|^[A-Za-z]:|\\\\|\\x00|(^|/)\\.\\.(/|$)")) & (path != "")


def links(html: Column) -> Column:
    """Targets of anchors, without empty, fragment, mail and phone links and without fragments; first of equals stays."""
    found = F.regexp_extract_all(html, F.lit('<a\\s[^>]*href="([^"]*)"'), F.lit(1))
    kept = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~F.regexp_like(x, F.lit("^$|^#|^(?i:mailto|tel):")))
    return F.array_distinct(F.transform(kept, lambda x: F.split(x, "#")[0]))


def without_dots(path: Column) -> Column:
    """A path with its dot parts resolved: . goes, .. goes with the part before it, none leaves the root; a dot part at the end leaves a slash there."""
    parts = F.split(path, "/")
    up, here = lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e"), lambda x: F.lower(x).isin(".", "%2e")
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(up(x), F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).when(here(x), done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, none, step)
    last = F.element_at(parts, -1)
    return F.when(~F.regexp_like(path, F.lit("(?i)(^|/)(\\.|%2e)")), path).otherwise(F.concat(F.array_join(kept, "/"), F.when(up(last) | here(last), "/").otherwise("")))


def resolve(link: Column, page: Column) -> Column:
    """Absolute form of absolute, scheme-relative, rooted, relative and query-only links, dot parts resolved; null for other schemes."""
    scheme, authority = F.try_parse_url(page, F.lit("PROTOCOL")), F.try_parse_url(page, F.lit("AUTHORITY"))
    root = F.concat(scheme, F.lit("://"), authority)
    own = F.coalesce(F.try_parse_url(page, F.lit("PATH")), F.lit("/"))
    folder = F.regexp_replace(own, "[^/]*$", "")
    target = (
        F.when(F.regexp_like(link, F.lit("^(?i:https?)://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.regexp_like(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), None)
        .when(F.startswith(link, F.lit("?")), F.concat(root, F.when(own == "", "/").otherwise(own), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    shape = "^([a-zA-Z]+://[^/?#]*)([^?#]*)(.*)$"
    dotted = F.regexp_like(target, F.lit("(?i)^[a-z]+://[^?#]*/(\\.|%2e){1,2}(/|\\?|#|$)"))
    return F.when(dotted, F.concat(F.regexp_extract(target, shape, 1), without_dots(F.regexp_extract(target, shape, 2)), F.regexp_extract(target, shape, 3))).otherwise(target)
