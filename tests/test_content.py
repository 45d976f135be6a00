"""Line differences, places of matches, main text, JSON trees and sources on odd inputs, against plain computations."""

import json
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import html, places, text, urls
from gaugewright.operators import criteria, json_trees, linediff, publish, records
from gaugewright.sources import delimited, files, paged, sitemap


def lcs(a, b):
    """Length of a longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_edit_scripts_are_shortest_and_turn_old_into_new(spark):
    pick = random.Random(4)
    rows = [(k, "\n".join(pick.choices("abcde", k=pick.randint(0, 30))), "\n".join(pick.choices("abcdef", k=pick.randint(0, 30)))) for k in range(60)]
    same = "\n".join(f"line {i}" for i in range(3000))
    rows += [(100, None, "x\ny\n"), (101, "x\r\ny", "x\ny\n"), (102, "", None), (103, same, same.replace("line 7\n", "") + "\nend"), (104, "a\na\na", "a\na"), (105, "", ""), (None, "a", "b"), (106, "x\n\ny", "\n")]
    table = spark.createDataFrame(rows, "k int, old string, new string").withColumn("line", F.lit("clash"))
    script = {}
    for r in linediff.edit_script(table, "k", "old", "new").collect():
        script.setdefault(r.k, {"added": {}, "removed": {}})[r.change][r.place] = r.line
    lines = lambda t: [] if not t else t.removesuffix("\n").replace("\r\n", "\n").split("\n")
    for k, old, new in rows:
        if k is None:
            continue
        a, b, found = lines(old), lines(new), script.get(k, {"added": {}, "removed": {}})
        kept = [x for n, x in enumerate(a, 1) if n not in found["removed"]]
        assert kept == [x for n, x in enumerate(b, 1) if n not in found["added"]]
        assert all(a[n - 1] == x for n, x in found["removed"].items()) and all(b[n - 1] == x for n, x in found["added"].items())
        if len(a) < 100:
            assert len(kept) == lcs(a, b), (k, old, new)
    assert len(script[103]["removed"]) == 1 and len(script[103]["added"]) == 1 and None not in script


def test_change_counts_and_hunks(spark):
    table = spark.createDataFrame([(1, "a\n-b\nc", "a\n+x\ny\nz\nc"), (2, "q", "q")], "k int, old string, new string")
    assert sorted(tuple(r) for r in linediff.change_counts(table, "k", "old", "new").collect()) == [(1, 2, 0), (2, 0, 0)]
    runs = linediff.hunks(linediff.edit_script(table, "k", "old", "new"), "k").collect()
    assert sorted((r.change, r["first"], r.lines) for r in runs) == [("added", 2, 3), ("removed", 2, 1)]
    assert linediff.edit_script(table.where("false"), "k", "old", "new").count() == 0


def test_common_places_of_long_lists():
    pick = random.Random(1)
    a, b = pick.choices(range(40), k=400), pick.choices(range(40), k=380)
    found = linediff.common_places(a, b)
    assert len(found) == lcs(a, b) >= sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(
    ("raw", "needle", "want"),
    [("At Yahoo\\!ショッピング now", "yahoo!ショッピング", "Yahoo\\!ショッピング"), ("x 😀 Straße", "strasse", "Straße"), ("Café Café", "CAFE CAFE", "Café Café"), ("쿠팡이", "쿠팡", "쿠팡"), ("ab", "ab", None), ("nothing", "else", None), ("", "abc", None), ("straße", "sse", "ße"), ("Ελλάδα", "ελλαδα", "Ελλάδα")],
)
def test_place_of_a_fuzzy_match(raw, needle, want):
    found = places.place_of(raw, needle)
    units = raw.encode("utf-16-le")
    assert (found and units[2 * found[0] : 2 * found[1]].decode("utf-16-le")) == want


def test_places_and_folds_as_columns(spark):
    rows = spark.createDataFrame([("x 😀 Ёлка", "елка"), (None, "abc"), ("abc", None), ("Việt Nam, ΆΛΦΑ", "viet nam")], "t string, n string")
    at = places.fuzzy_place(F.col("t"), F.col("n"))
    got = rows.select(at.alias("at"), places.cut_utf16(F.col("t"), at["begin"], at["end"]).alias("cut"), text.fold(F.col("t")).alias("folded"), places.decomposed(F.col("t")).alias("apart")).collect()
    assert [r.cut for r in got] == ["Ёлка", None, None, "Việt Nam"] and got[0]["at"]["begin"] == 5
    assert got[3].folded == got[3].apart == "viet nam, αλφα"
    words = spark.createDataFrame([("ΆΛΦΑ", "αλφα"), ("a", "b")], "a string, b string")
    assert [r.s for r in words.select(places.same_letters(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False]
    order = spark.createDataFrame([(w,) for w in ("b", "B", "ä", "a", "z", "Z", "é")], "w string").orderBy(places.in_order(F.col("w")))
    assert [r.w for r in order.collect()] == ["a", "ä", "b", "B", "é", "z", "Z"]


def test_every_letter_with_marks_folds_alike(spark):
    letters = [chr(c) for c in [*range(0xC0, 0x3000), *range(0xFB00, 0xFB07)] if unicodedata.category(chr(c))[0] == "L" and chr(c).lower() == chr(c)]
    singles = [c for c in letters if len([x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ"]) == 1]
    got = spark.createDataFrame([(c,) for c in singles], "c string").select("c", text.fold(F.col("c")).alias("a"), places.decomposed(F.col("c")).alias("b")).collect()
    assert [r.c for r in got if r.a != r.b] == []


def test_main_text_of_nested_and_broken_pages(spark):
    pages = [
        "<header>a<header>b</header>c</header>d<footer><nav>e</nav>f</footer>g", "<nav>a<p>b", "x<main>a<aside>b</aside>c</main>d<main>e</main>", "<main>a", "<div class='x' id=\"shopify-section-cart-drawer\">a<div>b</div></div>c", '<span class="k Sr-Only">a</span>b<p class="note">c</p>',
        "</nav>a<nav>b</nav>c", None, "", "a<script><nav></script>b", "1 / of 3 Play video 50% (7) Skip to content x",
    ]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", html.main_text(F.col("html")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["d g", "a b", "a c", "a", "c", "b c", "a c", "", "", "a b", "x"]
    long = spark.createDataFrame([("<p>" + "x" * 500 + "</p>",)], "html string").select(html.main_text(F.col("html"), 100).alias("t")).first().t
    assert len(long) == 100 and long == "x" * 66 + " […] " + "x" * 29


def test_item_counts_of_deep_and_odd_trees(spark):
    deep = lambda n: {"count": 1} if n == 0 else {"a": deep(n - 1)}
    trees = [{"count": 99}, {"count": ["3", 4, "x", True, None, 2.5, "-2", " 7 "]}, deep(8), deep(9), {"a": json.dumps({"b": json.dumps({"num_intro": 5})})}, {"Counts": 1, "discount": 2, "x[count]": 3}, [[{"COUNT": 6}]], {"a": "{broken"}, "text"]
    rows = [(k, json.dumps(t)) for k, t in enumerate(trees)] + [(20, "no json"), (21, None), (22, '{"count":1}'), (22, '{"count":2}')]
    got = {r.k: r["items"] for r in json_trees.item_counts(spark.createDataFrame(rows, "k int, body string"), "k", "body").collect()}
    assert got == {0: 24, 1: 3 + 4 - 2 + 7, 2: 1, 3: 0, 4: 5, 5: 3, 6: 6, 7: 0, 8: 0, 20: 0, 21: 0, 22: 3}


def test_retargeted_and_merged_trees(spark):
    body = {"CatId": 5, "b": {"categories": ["1", "2"], "x": [{"catid": []}, 1, {}]}, "s": '{"catid": "9", "é": []}', "t": "{no", "e": {}, "catids": {"deep": 1}}
    (r,) = spark.createDataFrame([(json.dumps(body), "77")], "b string, t string").select(json_trees.retargeted(F.col("b"), F.col("t")).alias("j")).collect()
    assert json.loads(r.j) == {"CatId": "77", "b": {"categories": ["77"], "x": [{"catid": ["77"]}, 1, {}]}, "s": '{"catid":"77","é":[]}', "t": "{no", "e": {}, "catids": "77"}
    cases = [
        ({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"a": {"b": 3, "c": 2}}), ({"a": 1}, {"a": {"b": 2}}, {"a": {"b": 2}}), ({"a": {"b": 1}}, {"a": 2}, {"a": 2}), ({"a": {}}, {"a": {"b": 1}}, {"a": {"b": 1}}), ({"a": {"b": 1}}, {"a": {}}, {"a": {"b": 1}}),
        ({}, {"x": None}, {"x": None}), ({"a": [1, 2]}, {"a": [3]}, {"a": [3]}), ({"p": {"rows": 1, "u": [1], "v": [1]}}, {"p": {"u": [1, 2, 3]}}, {"p": {"rows": 3, "u": [1, 2, 3], "v": [1]}}), ({"p": {"rows": 7, "u": [1]}}, {"q": 1}, {"p": {"rows": 7, "u": [1]}, "q": 1}),
        ({"a": {"b": {"c": 1}}}, {"a": {"b": {"d": {"e": []}}}}, {"a": {"b": {"c": 1, "d": {"e": []}}}}), ({"a": {"b": 1}}, {"a": [1]}, {"a": [1]}),
    ]
    for base, over, want in cases:
        assert json_trees.merged(base, over) == want, (base, over)


def test_delimited_lines(spark):
    lines = spark.createDataFrame([("1|a|eA==",), ("2|\\N|\\N",), ("x|a|eA==",), ("3|a",), ("4|a|eA==|z",), ("5||eA=",), ("6|q|/w==",), ("  ",), ("7||",)], "value string").withColumn("id", F.lit("kept"))
    rows, rejected = delimited.rows_of(lines, "n int, name string, note string", {"note"})
    assert sorted((r.n, r.name, r.note) for r in rows.where("n <> 2").collect()) == [(1, "a", "x"), (7, "", "")]
    assert rows.where("n = 2 and name is null and note is null and id = 'kept'").count() == 1
    assert sorted((r.value[0], r.reason) for r in rejected.collect()) == [("3", "too few fields"), ("4", "too many fields"), ("5", "note is no base64 of text"), ("6", "note is no base64 of text"), ("x", "n is no int")]


def test_paged_source_stops_at_the_budget(spark, tmp_path):
    def answer(site, kind, page, items):
        folder = tmp_path / site / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{page}.json").write_text(items if isinstance(items, str) else json.dumps(items))

    item = lambda i: {"id": i, "link": f"/{i}", "title": {"rendered": f"<i>T</i> {i}"}, "categories": [1, "x", True], "modified": 3}
    answer("a", "posts", 1, [item(1), {"id": "2", "link": "/2"}, item(3)])
    answer("a", "posts", 2, [item(4), item(5), item(6)])
    (tmp_path / "a" / "posts" / "3.json").mkdir()  # would fail if it was read
    (tmp_path / "a" / "pages" / "1.json").mkdir(parents=True)
    answer("b", "posts", 1, "<html>")
    answer("b", "pages", 1, [item(7), item(8)])
    got = paged.paged(spark, str(tmp_path), budget=4, per_page=3, partitions=5).collect()
    assert sorted((r.site, r.kind, r.id, r.page, r.kept) for r in got) == [("a", "post", 1, 1, True), ("a", "post", 3, 1, True), ("a", "post", 4, 2, True), ("a", "post", 5, 2, True), ("a", "post", 6, 2, False), ("b", "page", 7, 1, True), ("b", "page", 8, 1, True)]
    assert {(r.title, tuple(r.categories), r.modified) for r in got if r.id == 1} == {("T 1", (1,), "")}


def test_sitemap_frontier_of_cycles_and_missing_answers(spark):
    index, urlset = (lambda *x: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in x)), (lambda *x: "".join(f"<loc> {u} </loc>" for u in x))
    answers = [("s", "http://s/1", index("http://s/2", "http://s/3", "http://s/1", "http://s/none")), ("s", "http://s/2", index("http://s/1", "http://s/4", "http://s/3")), ("s", "http://s/3", urlset("http://s/a", "http://x/b", "http://s/c")), ("s", "http://s/4", urlset("http://s/c", "http://s/d"))]
    table = spark.createDataFrame(answers, "site string, loc string, text string")
    starts = spark.createDataFrame([("s", "http://s/0", 0), ("s", "http://s/1", 1), ("t", "http://t/1", 0)], "site string, loc string, pos int")
    got = lambda n: [r.url for r in sitemap.addresses(table, starts, n).orderBy("pos").collect()]
    assert got(3) == ["http://s/a", "http://s/c", "http://s/d"]
    assert got(2) == ["http://s/a", "http://s/c"]
    assert sitemap.addresses(table.where("false"), starts).count() == 0


def test_markdown_pairs(spark):
    body = "# First heading\n\n\nOne\ntwo\n\nthree\n## Short\nx\n```\n# in code here\n```\n# After the fence ##\n```\ncode\n```\nlate\n   ### Heading number four\n# Heading number five\nend"
    got = records.markdown_pairs(spark.createDataFrame([(1, body), (2, None), (3, ""), (None, "# Heading of none\nx")], "k int, body string"), "k", "body").orderBy("place").collect()
    assert [(r.k, r.heading, r.body) for r in got] == [(1, "First heading", "One two"), (1, "After the fence", ""), (1, "Heading number four", ""), (1, "Heading number five", "end")]


def test_dot_segments(spark):
    page = "https://a.org/b/c/d?x=/../y"
    want = {"../e": "https://a.org/b/e", "../../../../e/": "https://a.org/e/", "./": "https://a.org/b/c/", "..": "https://a.org/b/", "/x/./y/../z?q=../r#/..": "https://a.org/x/z?q=../r#/..", "?n=1": "https://a.org/b/c/d?n=1", "//b.org/a/../c": "https://b.org/c", "http://c.org/%2E%2e/d": "http://c.org/d", "...": "https://a.org/b/c/...", "mailto:x": None}
    got = spark.createDataFrame([(k,) for k in want], "link string").select("link", urls.resolve(F.col("link"), F.lit(page)).alias("u")).collect()
    assert {r.link: r.u for r in got} == want


def test_page_facts_of_missing_pages(spark):
    given = "html string, source_html string, name string, vendor string, shop string, search_blocked boolean, assistant_blocked boolean, audit int, as_of date"
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, 1, None), ("", "", "", "", "", False, False, 2, None), ("<h1>x</h1>", None, "x", "The Shop", "shop the", False, True, 3, None)], given)
    got = {(r.audit, r.key): (r.status, r.score) for r in criteria.measured(criteria.page_facts(rows), leave=criteria.OFF_PAGE).collect()}
    assert {v for (k, _), v in got.items() if k == 1} == {("na", None)} and len(got) == 45
    assert got[2, "heading-hierarchy"] == ("scored", 0) and got[2, "image-alt-text"] == ("na", None) and got[3, "heading-hierarchy"] == ("scored", 100) and got[3, "ai-bots-allowed"] == ("scored", 75)


def test_files_in_folders_of_their_own(spark, tmp_path):
    files.write_files(spark.createDataFrame([("a/b/c.txt", b"x"), ("d.txt", b"y")], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a" / "b" / "c.txt").read_text() == "x"


def test_run_tree_without_a_runs_folder(spark):
    graded = '{"summary":{"pass_rate":0.5,"passed":1,"failed":1,"total":2},"timing":{"total_duration_seconds":4.0}}'
    found = [("eval-3/a/run-2/grading.json", graded), ("eval-3/a/run-2/timing.json", '{"total_duration_seconds":9}'), ("eval-x/b/run-1/grading.json", "{}"), ("eval-x/b/run-1/timing.json", '{"total_duration_seconds":9,"total_tokens":8}'), ("eval-x/inputs/grading.json", graded), ("other/a/run-1/grading.json", graded), ("eval-y/a/run-1/grading.json", "{")]
    table = spark.createDataFrame([(f"file:/w/bench/{p}", t) for p, t in found], "path string, text string")
    rows = files.run_tree(table, "/w/bench").collect()
    assert sorted((r.eval_id, r.config, r.run, r.pass_rate, r.total, r.seconds, r.tokens) for r in rows) == [(1, "b", 1, 0.0, 0, 9.0, 8), (3, "a", 2, 0.5, 2, 4.0, 0)]


def test_cells_of_odd_files(spark):
    table = spark.createDataFrame([("a", '[{"n":1},{"n":2}]'), ("b", ' {"n":3}'), ("c", "[]"), ("d", "{"), ("e", None), ("f", "7")], "path string, text string")
    assert sorted((r.path, r["at"], r.record.n) for r in files.cells(table, "n int").collect() if r.record.n) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 3)]


def test_json_schema_is_that_of_the_writer(spark):
    schema = spark.sql("select 'x' as a, 1 as b, array(1.5) as c, map('k', date'2020-01-01') as d, named_struct('e', true) as f, cast(null as timestamp) as g").schema
    told = json.loads(publish.json_schema(schema, "rows"))
    assert told["title"] == "rows" and told["required"] == ["a", "b", "c", "d", "f"] and told["additionalProperties"] is False
    assert told["properties"]["c"] == {"type": "array", "items": {"type": "number"}} and told["properties"]["d"]["additionalProperties"] == {"type": "string", "format": "date"}
    assert told["properties"]["f"]["properties"]["e"] == {"type": "boolean"} and told["properties"]["g"]["format"] == "date-time"


def test_reports_of_audits_without_scores(spark):
    rows = spark.createDataFrame([(1, "k1", "f", "na", None, 60.0, 1), (1, "k2", "f", "inactive", None, 40.0, 2), (2, "k1", "f", "scored", 100.0, 60.0, 1), (2, "k2", "f", "scored", 0.0, 40.0, 2)], "audit int, key string, factor string, status string, score double, global_weight double, ordinal int")
    got = {r.audit: r for r in publish.reports(rows, "audit", F.lit("s"), F.lit("t")).collect()}
    one, two = (json.loads(got[k].payload)["audit"] for k in (1, 2))
    assert one["score"] is None and one["verdict"] is None and one["topPriorities"] == [] and "No score" in got[1].summary
    assert two["score"] == 60.0 and two["topPriorities"] == ["k2"] and two["coverage"] == {"total": 2, "scored": 2, "na": 0, "inactive": 0}


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"n":1},\n{"n":2}]\n')
    (row,) = files.documents(spark, str(tmp_path)).collect()
    assert row.text == ' [{"n":1},\n{"n":2}]\n' and row.path.endswith("/a.json")
