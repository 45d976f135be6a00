"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
import pytest

from gaugewright.llm import decontaminate, langid
from gaugewright.llm.common import keep, read

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF), name)
        seen[name] = (before.collect(), docs.collect())
        if name != "mixture":
            assert docs.columns == columns

    before, after = seen["language"]
    rejected = {r.doc_id for r in langid.identify(read(spark, SF, "documents")).collect() if r.rejected}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == rejected
    assert len(after) > 0.98 * len(before)

    before, after = seen["lines"]
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n"))
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
    long_lines = [x.strip() for r in after for x in r.text.split("\n") if len(x.split()) >= 20]
    assert len(long_lines) == len(set(long_lines))
    assert {x.strip() for t in texts.values() for x in t.split("\n") if len(x.split()) >= 20} == set(long_lines)

    before, after = seen["near_copies"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = {d: d for d in sets}
    while any(part[a] != part[b] for a, b in links):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    assert {r.doc_id for r in after} == set(part.values())

    before, after = seen["benchmark"]
    items = [(r.item_id, r.text.encode()) for r in read(spark, SF, "benchmark").collect()]
    index = decontaminate.Index(items, 5)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not index.matches(r.text.encode(), 0.8)}
    squeezed = [b" ".join(decontaminate.words_of(t)) for _, t in items]
    assert not any(t in b" ".join(decontaminate.words_of(r.text.encode())) for r in after for t in squeezed)

    before, after = seen["mixture"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert all(r.rate >= 0 for r in after)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "tokens", "rate"} <= set(out.columns)
    assert out.count() > 50


ODD = "doc_id long, text string, lang string, source string, n_chars long, gw_doc string, mix_p int, node string, component string"


@pytest.fixture
def odd(spark, tmp_path):
    """Clean documents of the smallest table beside nulls, empty and very long texts, repeated rows; further columns with clashing names."""
    clean = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    own = " ".join(f"word{i}" for i in range(30))
    rows = [*clean, clean[0], clean[1], (None, clean[2][1], "en", "s", 1), (None, own, "en", None, None), (900, None, None, None, None), (901, "", "en", "", 0), (901, "", "en", "", 0), (902, " \n ", None, None, 3), (903, clean[3][1] + " the" * 60000, "en", "s", 240000), (904, "12 34 !", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "x", 7, None, "y") for r in rows], ODD)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    return docs, str(tmp_path), rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, name):
    docs, folder, rows = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, folder)
    left = out.collect()
    if name == "mixture":
        assert len(left) == len(rows) and set(docs.columns) - {"mix_p"} <= set(out.columns)
        assert all(r.rate >= 0 for r in left) and {r.tokens for r in left if not r.text} == {0}
        assert stage(spark, docs.where("false"), folder).count() == 0
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert all((r.gw_doc, r.mix_p, r.component) == ("x", 7, "y") for r in left)
    ids = [r.doc_id for r in left]
    if name == "language":
        assert not {900, 901, 902, 904} & set(ids)
    if name in ("lines", "benchmark"):
        assert {900, 901, 902} <= set(ids) and ids.count(901) == 2
    if name == "near_copies":
        assert 900 in ids and not {901, 902} & set(ids) and ids.count(None) == 2 and ids.count(rows[0][0]) == 2
    assert stage(spark, docs.where("false"), folder).count() == 0
