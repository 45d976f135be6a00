"""One test a finding of the third round: inputs, or spreads of work, that failed before."""

import time
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewright.functions import html
from gaugewright.operators import records
from gaugewright.operators.judgements import fit_budget
from gaugewright.queries import ORACLES, QUERIES, content, facts
from gaugewright.sources.stored import shared_folder

SF = "/root/testdata/sf0.001"


def test_heading_pairs_keep_the_entities_that_the_sql_keeps(spark, tmp_path):
    pages = [(1, "u", "<h1>a &quot;b&quot; &amp; c &lt;d&gt;</h1>"), (2, "u", "<h1>it&#39;s &amp;quot; <i>x</i></h1>"), (3, "u", "<h1>y</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["f54_heading_pairs"](spark, str(tmp_path)).select("page_id", "heading", "body").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(ORACLES["f54_heading_pairs"]).fetchall())


def test_record_files_are_files_written_by_all_tasks(spark):
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("records-*"))
    rows = QUERIES["s01_s16_s28_record_files"](spark, SF).collect()
    (folder,) = set(shared.glob("records-*")) - before
    files = [p for p in folder.rglob("*.txt")]
    assert len(files) == len(rows) > 0
    assert {(p.parent.name, p.stem) for p in files} == {(r.namespace, r.slug) for r in rows}  # in its namespace's folder, no folder of its own


def test_fit_budget_takes_no_more_steps_than_a_list_needs(spark):
    def kept(sizes, budget):
        n = len(sizes)
        while n > 1 and sum(sizes[:n]) + n - 1 > budget:
            n = max(1, int(n * 0.9))
        return n

    lists = {i: [i % 7 + j % 3 for j in range(i)] for i in range(1, 130)} | {1000: [1] * 200_000, 1001: [3] * 200_000}
    rows = spark.createDataFrame([(k, x) for k, x in lists.items()], "k int, sizes array<int>").select("k", F.transform("sizes", lambda n: F.repeat(F.lit("x"), n)).alias("lines"))
    began = time.monotonic()
    for budget in (40, 100_000):
        got = {r.k: r.n for r in rows.select("k", fit_budget(F.col("lines"), budget).alias("n")).collect()}
        assert got == {k: kept(x, budget) for k, x in lists.items()}
    assert time.monotonic() - began < 30  # sums of sums, of all leading lines, took the square of a list's length
    odd = spark.sql("select 1 as k, cast(null as array<string>) as lines union all select 2, array('a', null, 'b') union all select 3, array()").select("k", fit_budget(F.col("lines"), 40).alias("n"))
    assert {r.k: r.n for r in odd.collect()} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("made", [facts.shop, content.audited_pages, content.settings])
def test_work_on_parts_is_dealt_over_all_tasks(spark, made):
    assert made(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scan_tree_writes_a_file_a_page(spark, tmp_path):
    rows = [(1, "a", "k/1 %"), (1, "a", "k/1 %"), (2, None, "k/1 %"), (3, "c", "z"), (4, "d", ""), (5, "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, k string")
    records.scan_tree(pages, str(tmp_path), F.col("k"))
    assert len(list((tmp_path / "pages").rglob("*.json"))) == len(rows)
    got = spark.read.schema("page_id long, url string, page_key string").json(f"{tmp_path}/pages").collect()
    assert sorted(map(str, got)) == sorted(f"Row(page_id={i}, url={u!r}, page_key={(k or None)!r})" for i, u, k in rows)
    records.scan_tree(pages.where("page_id > 9"), str(tmp_path / "none"), F.col("k"))
    assert spark.read.schema("page_id long, page_key string").json(f"{tmp_path}/none/pages").count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_run_trees_read_their_files_twice(spark):
    df = QUERIES["s17_run_tree"](spark, SF)
    assert plan(df).count("Relation [") <= 4 * 4  # four parts of a union: for the evaluations and the runs, and the root of each; once eight times


def test_weighted_scores_repeat_sums_and_not_criteria(spark):
    text = plan(QUERIES["a13_weighted_scores"](spark, SF))
    assert "Aggregate" in text[text.index("Expand") :].split("Join")[0]


def test_main_regions_take_few_pages_at_once(monkeypatch):
    held = []
    region = html.main_region
    monkeypatch.setattr(html, "main_region", lambda p: held.append(p) or region(p))
    pages = pa.array(["<main>a<nav>b</nav></main>"] * 150 + [None, ""])
    assert html._main_regions(pages).to_pylist() == ["a "] * 150 + [None, ""] and len(held) == 151
    assert html._main_regions(pa.array([], pa.string())).to_pylist() == [] and html.PAGES_AT_ONCE < 150
