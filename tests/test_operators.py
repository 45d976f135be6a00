"""Operators and functions on small fixtures: the cases that the test tables do not hold."""

import math

from pyspark.sql import functions as F

from gaugewright.functions import html, text, urls, versions
from gaugewright.operators import conversations, entities, findings, graph, layout, ranking, reconcile, rules, scoring, stats
from gaugewright.sources import sitemap
from gaugewright.streaming import incremental

PAGE = """<html><head><title> Red  Shoe&nbsp;| Shop </title><meta name="description" content="Shoes"><link rel="canonical" href="https://s.com/p">
<script type="application/ld+json">{"@context":"x","@graph":[{"@type":["Product","Thing"],"name":"Shoe","offers":{"@type":"Offer","price":"5"}}]}</script>
<script type="application/ld+json">{broken</script></head><body><h1>Red</h1><h3>Skip</h3><h2></h2>
<a href="/a#x">1</a><a href=" ">2</a><a href="#f">3</a><a href="mailto:a@b">4</a><a href="//cdn.s.com/q">5</a><a href="rel">6</a><a href="https://o.org/z">7</a><a href="javascript:x()">8</a></body></html>"""


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_html(spark):
    h = F.col("h")
    ((title, meta, canonical, levels, skips, nodes, links),) = values(
        spark, [(PAGE,)], "h string", html.title(h), html.meta(h, "description"), html.canonical(h), html.heading_levels(h), html.skips_level(html.heading_levels(h)), html.json_ld(h), urls.links(h)
    )
    assert (title, meta, canonical) == ("Red Shoe&nbsp;| Shop", "Shoes", "https://s.com/p")
    assert (levels, skips) == ([1, 3, 2], True)
    assert [(n["depth"], n["types"], n["name"]) for n in nodes] == [(0, [], None), (1, ["Product", "Thing"], "Shoe"), (2, ["Offer"], None)]
    assert links == ["/a", "//cdn.s.com/q", "rel", "https://o.org/z", "javascript:x()"]


def test_arrival(spark):
    pages = [("<html></html>",), ("<p>captcha</p>",), ("<script>" + "x" * 3000 + "</script>",), (PAGE,)]
    assert [r[0] for r in values(spark, pages, "h string", html.arrival(F.col("h")))] == ["empty", "bot-wall", "js-shell", "received"]


def test_urls(spark):
    u, v = F.col("u"), F.col("v")
    rows = [("https://www.A.com:80/x/y.html?q#f", "http://a.com/"), ("bad url", "http://a.com"), (None, None)]
    got = values(spark, rows, "u string, v string", urls.host(u), urls.same_site(u, v), urls.depth(u), urls.section(u), urls.resolve(F.lit("z"), u), urls.resolve(F.lit("/z"), u))
    assert got[0] == ("a.com", True, 2, "x", "https://www.A.com:80/x/z", "https://www.A.com:80/z")
    assert got[1][1] is False and got[2][1] is False
    paths = [("ok/a", True), ("/abs", False), ("C:x", False), ("a/../b", False), ("a\\b", False), ("", False)]
    assert values(spark, paths, "p string, want boolean", urls.is_safe_path(F.col("p")), "want") == [(w, w) for _, w in paths]


def test_text(spark):
    t = F.col("t")
    rows = [("Crème Brûlée — Straße Ø",), ("",), (None,)]
    assert values(spark, rows, "t string", text.fold(t))[0] == ("creme brulee — strasse o",)
    assert values(spark, rows, "t string", text.tokens(t))[0] == (["creme", "brulee", "strasse", "o"],)
    assert [r[0] for r in values(spark, rows, "t string", text.word_count(text.squeeze(t)))] == [5, 0, 0]
    assert values(spark, [("<b>5 &lt; 6 &amp; &eacute;</b><script>x</script> .",)], "t string", text.strip_tags(t), text.html_text(t))[0][0] == "5 6 & ."
    numbers = [(" 12.5 ", 12.5), ("", None), ("x", None), ("NaN", None), ("Infinity", None), ("1e3", 1000.0)]
    assert values(spark, numbers, "t string, want double", text.to_number(t), "want") == [(w, w) for _, w in numbers]
    codes = [("4006381333931", True), ("4006381333932", False), ("96385074", True), ("12345", False)]
    assert values(spark, codes, "t string, want boolean", text.gtin_valid(t), "want") == [(w, w) for _, w in codes]
    dates = [("2024-02-03T10:00", "2024-02-03"), ("2/2024", "2024-02-01"), ("2024", "2024-01-01"), ("soon", None), ("2024-13-40", None)]
    assert values(spark, dates, "t string, want string", text.loose_date(t).cast("string"), "want") == [(w, w) for _, w in dates]
    assert [r[0] for r in values(spark, [("costs €5",), ("5 USD",), ("five",)], "t string", text.states_money(t))] == [True, True, False]
    phones = [("+1 (555) 123-4567", "555 123 4567", True), ("12345", "12345", False)]
    assert values(spark, phones, "a string, b string, want boolean", text.same_phone(F.col("a"), F.col("b")), "want") == [(w, w) for *_, w in phones]


def test_versions(spark):
    v = F.col("v")
    rows = [("3.9.1", "3.10>4.4>5.4>6.1"), ("3.10.12", "4.4>5.4>6.1"), ("5.2.0", "5.4>6.1"), ("6.1.3", ""), ("x", None), (None, None)]
    assert values(spark, rows, "v string, want string", F.array_join(versions.hops(v), ">"), "want") == [(w, w) for _, w in rows]
    assert values(spark, [("8.10", "8.9"), ("8.1", "8.1.0")], "v string, w string", versions.at_least(v, F.col("w"))) == [(True,), (False,)]


def test_findings(spark):
    facts = spark.createDataFrame([(i, f"u{i}", "same" if i < 30 else None) for i in range(40)], "pos int, url string, title string")
    checks = [findings.Check("none", "No title", 2, F.col("title").isNull()), findings.Check("dup", "Shared", 1, F.col("shared")), findings.Check("never", "Never", 1, F.lit(False)), findings.Check("scoped", "Scoped", 1, F.lit(True), F.col("pos") < 3)]
    rows = findings.ranked(findings.findings(findings.duplicates(facts, "title", "shared"), checks, "url", "pos")).collect()
    assert [(r.check_id, r["count"], len(r.subjects)) for r in rows] == [("dup", 30, 20), ("scoped", 3, 3), ("none", 10, 10)]
    assert rows[0].subjects == [f"u{i}" for i in range(20)]


def test_graph(spark):
    pages = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("a", "x", 4), ("b", "x", 5), ("x", "d", 6)], "source string, target string, pos int")
    assert {(r.url, r.depth) for r in graph.depths(pages, edges, pages.where("url = 'a'")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.url for r in graph.orphans(pages, edges, "e").collect()} == set()
    assert [tuple(r) for r in graph.outside_targets(edges, pages, "pos").collect()] == [("x", "a")]


def test_scoring(spark):
    total = F.round(F.sum("global_weight"), 6)
    assert scoring.criteria(spark).agg(total).first()[0] == 100.0
    rows = [("x", "scored", 100.0, 3), ("x", "scored", 0.0, 1), ("x", "na", None, 9), ("y", "gated", None, 1)]
    mean = scoring.weighted_mean(F.col("w"), F.col("s"), F.col("status")).alias("m")
    df = spark.createDataFrame(rows, "k string, status string, s double, w int").groupBy("k").agg(mean)
    assert {(r.k, r.m) for r in df.collect()} == {("x", 75.0), ("y", None)}
    assert [r[0] for r in values(spark, [(None,), (49.9,), (50.0,), (80.0,)], "t double", scoring.tier(F.col("t")))] == [None, "weak", "moderate", "strong"]
    assert values(spark, [(0, 0), (3, 3), (1, 1)], "n int, g int", scoring.faq_score(F.col("n"), F.col("g"), F.col("g"), F.lit(0), F.col("g"), F.col("g"))) == [(0.0,), (100.0,), (33.0,)]
    assert values(spark, [(5.0,), (40.0,), (22.5,), (-90.0,)], "g double", scoring.gap_score(F.col("g"))) == [(100.0,), (0.0,), (50.0,), (100.0,)]


def test_reconcile(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "k string, v string")
    assert {(r.k, r.state) for r in reconcile.compare(old, new, ["k"], "v").collect()} == {("a", "missing"), ("b", "modified"), ("c", "identical"), ("d", "added")}
    before = spark.createDataFrame([("p", None), ("q", True), ("r", False)], "check_id string, platform_limit boolean")
    assert [r.check_id for r in reconcile.closed(before, before.where("check_id = 'r'")).collect()] == ["p"]
    inventory = spark.createDataFrame([("u", "1"), ("v", None), ("w", "2")], "url string, lastmod string")
    state = spark.createDataFrame([("u", "1"), ("v", None), ("w", "1")], "url string, lastmod string")
    assert {(r.url, r.reuse) for r in reconcile.reusable(inventory, state).collect()} == {("u", True), ("v", False), ("w", False)}


def test_entities(spark):
    names = spark.createDataFrame([("rsformpro",), ("abc",), (None,)], "n string")
    titles = spark.createDataFrame([("rsform", 1), ("rsformp", 2), ("abc", 3)], "t string, id int")
    assert {(r.n, r.id) for r in entities.by_longest_prefix(names, "n", titles, "t", "id").collect()} == {("rsformpro", 2), ("abc", None), (None, None)}
    packages = spark.createDataFrame([(1, "A", "plugin", "K2", "g"), (2, "B", "Plugin", "k2", "G"), (3, "C", "plugin", "k2", "")], "ordinal int, label string, type string, element string, grp string")
    assert {tuple(r) for r in entities.claims(packages).collect()} == {("plugin", "k2", "g", "B"), ("plugin", "k2", "", "C")}


def test_ranking_layout_rules_and_stats(spark):
    needs = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0)], "k string, n int")
    assert [(r.k, r.seat) for r in ranking.round_robin(needs, "k", "n").orderBy("turn").collect()] == [("b", 1), ("a", 1), ("b", 2), ("b", 3)]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 300.0, 300.0), (1, 2, 250.0, 250.0, 600.0, 600.0), (1, 3, 10.0, 10.0, 20.0, 20.0), (1, 4, 299.0, 0.0, 400.0, 100.0)], "p int, i int, left double, top double, right double, bottom double")
    assert [tuple(r) for r in layout.overlaps(boxes, "p", "i").collect()] == [(1, 1, 2, 50.0, 50.0)]
    rows = spark.createDataFrame([(1, "ok", "a/b", 5, True, None), (2, "Bad", "../x", 0, False, None)], "id int, namespace string, path string, run_minutes int, auto_install boolean, label string")
    assert {tuple(r) for r in rules.violations(rows, rules.record_rules(), "id").collect()} == {(1, "label-required"), (2, "bad-namespace"), (2, "unsafe-path"), (2, "bad-minutes")}
    one = stats.summary(spark.createDataFrame([("x", 2.0)], "g string, v double"), "g", "v").first()
    assert (one.mean, one.stddev, one.n) == (2.0, 0.0, 1) and not math.isnan(one.stddev)
    split = stats.holdout(spark.createDataFrame([("a" if i < 100 else "b", i) for i in range(102)], "l string, i int"), "l", "i", 0.25)
    assert {(r.l, r.n) for r in split.where("test").groupBy("l").agg(F.count("*").alias("n")).collect()} == {("a", 25), ("b", 1)}


def test_robots_and_sitemaps(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: *\nDisallow:\n"
    rules_table = sitemap.robots_rules(spark.createDataFrame([(1, body)], "site int, body string"))
    paths = spark.createDataFrame([(1, "/x/1"), (1, "/x/y"), (1, "/z")], "site int, path string")
    assert {(r.path, r.allowed) for r in sitemap.allowed(paths, rules_table, "B-bot").collect()} == {("/x/1", False), ("/x/y", True), ("/z", True)}
    assert all(r.allowed for r in sitemap.allowed(paths, rules_table, "other").collect())
    maps = spark.createDataFrame([(1, "<urlset><url><loc> https://a/1 </loc></url><url><loc/></url><url><loc>https://a/2</loc><lastmod>2024</lastmod></url>"), (2, "not xml <url>")], "id int, xml string")
    assert [tuple(r) for r in sitemap.entries(maps, "xml").orderBy("loc").collect()] == [(1, "https://a/1", None), (1, "https://a/2", "2024")]
    found = spark.createDataFrame([("s", 2, 1, "u", "x"), ("s", 1, 2, "v", None), ("s", 1, 3, "v", "late")], "site string, priority int, pos int, loc string, lastmod string")
    assert [(r.loc, r.lastmod, r.pos) for r in sitemap.first_sitemap(found).collect()][0][0] == "v"


def test_paragraphs_and_state(spark, tmp_path):
    assert values(spark, [("a\na\n\na\nb\nb",), ("",)], "t string", conversations.without_consecutive(F.col("t"), "\n")) == [("a\n\na\nb",), ("",)]
    for i in range(3):
        spark.range(i * 2, i * 2 + 4).selectExpr("id % 5 as k", "id as v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = incremental.file_stream(spark, str(tmp_path), "t")
    assert {(r.k, r.v) for r in incremental.upserted(stream, ["k"], "v").collect()} == {(0, 5), (1, 6), (2, 7), (3, 3), (4, 4)}
