"""Files, images and sinks: round trips and damaged inputs."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import answers, publish
from gaugewright.sources import files, images


def test_records_missing_and_malformed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"slug": "x"}')
    (tmp_path / "a" / "y.json").write_text("{broken")
    (tmp_path / "a" / "z.txt").write_text("no")
    found = files.parsed(files.documents(spark, str(tmp_path)), "slug string").withColumn("path", files.path_part(F.col("path"), 1))
    listed = spark.createDataFrame([("x.json",), ("y.json",), ("w.json",)], "path string")
    got = {r.path: (r.state, r.record and r.record.slug) for r in files.with_missing(listed, found).collect()}
    assert got == {"x.json": ("ok", "x"), "y.json": ("malformed", None), "w.json": ("missing", None)}


def test_catalog_keeps_the_last_record_and_refuses_nothing(spark):
    schema = "slug string, n int"
    lines = spark.createDataFrame([(1, '{"slug":"a","n":1}'), (2, "broken"), (3, '{"slug":"a","n":2}'), (4, "")], "pos int, value string")
    assert [(r.slug, r.record.n) for r in files.catalog(lines, schema).collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="no records"):
        files.catalog(lines.where("pos = 2"), schema)


def test_evaluation_runs(spark):
    grading = [("/d/eval-1/with/run-1/grading.json", '{"summary":{"pass_rate":0.5},"timing":{"total_duration_seconds":0.0}}'), ("/d/eval-1/with/run-2/grading.json", "{bad")]
    timing = [("/d/eval-1/with/run-1/timing.json", '{"total_duration_seconds": 12.5}')]
    schema = "path string, text string"
    (row,) = files.evaluation_runs(spark.createDataFrame(grading, schema), spark.createDataFrame(timing, schema)).collect()
    assert tuple(row) == ("eval-1", "with", "run-1", 0.5, 12.5, 0)


def test_event_lines_front_matter_and_age(spark):
    lines = spark.createDataFrame([('data: {"k": 1}',), ('{"k": 2}',), (": ping",), ("data: {bad}",), ("",)], "value string")
    assert sorted(r.event.k for r in files.event_lines(lines, "k int").collect()) == [1, 2]
    texts = spark.createDataFrame([('---\nname: "A b"\ntags: x\n---\nbody',), ("no block",)], "t string")
    assert [r[0] for r in texts.select(files.front_matter(F.col("t"))).collect()] == [{"name": "A b", "tags": "x"}, None]
    assert [r[0] for r in spark.createDataFrame([("public $db = 'x';",), ("",)], "t string").select(files.config_value(F.col("t"), "db")).collect()] == ["x", None]
    days = spark.sql("select date '2024-01-05' - make_interval(0, 0, 0, d) as then from values (0), (1), (9) t(d)")
    assert [r[0] for r in days.select(files.age_in_days(F.col("then"), F.lit("2024-01-05").cast("date"))).collect()] == ["today", "1 day", "9 days"]


def png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    if channels == 3:
        pixels = np.concatenate([pixels, np.full((height, width, 1), 255, np.uint8)], axis=2)
    return images.encode(width, height, pixels.astype(np.uint8).tobytes())


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    held = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(held))
    (tmp_path / "broken.png").write_bytes(png(held)[:40])
    found = images.read(spark, str(tmp_path))
    assert {r.name: (r.width, r.height) for r in found.collect()} == {"a.png": (7, 5), "broken.png": (-1, -1)}
    rows = {(r.y, r.x): (r.r, r.g, r.b) for r in images.pixels(found).collect()}
    assert len(rows) == 35
    for y in range(5):
        for x in range(7):
            alpha = held[y, x, 3] / 255
            assert np.allclose(rows[y, x], 255 + (held[y, x, :3].astype(float) - 255) * alpha)


def test_compared_images(spark, tmp_path):
    white = np.full((3, 4, 3), 255)
    dark, faint = white.copy(), white.copy()
    dark[1, 2], faint[1, 2] = 0, 250
    for side, shots in {"before": {"dark": white, "faint": white, "same": white, "wide": white, "gone": white}, "after": {"dark": dark, "faint": faint, "same": white, "wide": np.full((3, 5, 3), 255), "new": white}}.items():
        (tmp_path / side).mkdir()
        for name, pixels in shots.items():
            (tmp_path / side / f"{name}.png").write_bytes(png(pixels))
    got = images.compared(*(images.read(spark, f"{tmp_path}/{side}") for side in ("before", "after")))
    assert {r.name: (r.changed, r.total, r.percent, r.state) for r in got.collect()} == {
        "dark.png": (1, 12, 8.3333, "same-size"), "faint.png": (0, 12, 0.0, "same-size"), "same.png": (0, 12, 0.0, "same-size"),
        "wide.png": (None, None, None, "size-changed"), "gone.png": (None, None, None, "missing"), "new.png": (None, None, None, "added"),
    }


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("n", "a", "it's", 1), ("m", "b", None, 2)], "ns string, slug string, text string, n int")
    publish.snapshot(rows, str(tmp_path), ["slug"], "ns")
    publish.snapshot(rows.where("n = 1"), str(tmp_path), ["slug"], "ns")
    assert spark.read.json(f"{tmp_path}/index").count() == 1
    assert [r.slug for r in spark.read.json(f"{tmp_path}/search").collect()] == ["a"]
    new = spark.createDataFrame([("m", "b", "new", 3), ("k", "c", "x", 4)], rows.schema)
    assert {(r.slug, r.n) for r in publish.upserted(rows, new, ["slug"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {(r.slug, r.n) for r in publish.inserted(rows, new, ["slug"]).collect()} == {("a", 1), ("b", 2), ("c", 4)}
    assert publish.restored(rows, "n", 2).count() == 1
    assert [r[0] for r in rows.select(publish.insert_statement("t", ["slug", "text", "n"])).collect()] == ["INSERT INTO t (slug, text, n) VALUES ('a', 'it''s', '1');", "INSERT INTO t (slug, text, n) VALUES ('b', NULL, '2');"]
    (text,) = spark.range(1).select(publish.envelope("audit", "x", F.array(F.lit("f")), F.array(F.lit("db")))).first()
    assert json.loads(text) == {"schemaVersion": 1, "kind": "audit", "label": "x", "status": "partial", "findings": ["f"], "unavailable": ["db"]}


def test_support(spark):
    rows = [("Gymshark", "gymshark.com", None, "Try Gym-Shark today", [], True), ("Shark", "shark.com", None, "nothing", ["gymshark.com"], False), ("Shark", "shark.com", None, "nothing", ["eu.shark.com"], True), ("Ab", None, None, "abba", [], False), ("Blue River Store", None, "the river runs deep", "Here the river runs deep.", [], True)]
    df = spark.createDataFrame(rows, "name string, domain string, evidence string, answer string, cited array<string>, want boolean")
    got = df.select(answers.supported(*(F.col(c) for c in ("name", "domain", "evidence", "answer", "cited"))), "want").collect()
    assert [r[0] for r in got] == [r.want for r in got]


SHARED = """
import sys
from pyspark.sql import SparkSession
from gaugewright.sources import files, stored
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (b.config("spark.checkpoint.dir", sys.argv[1]) if sys.argv[1] else b).getOrCreate()
rows = stored.stored(spark.createDataFrame([("a b.txt", b"x")], "name string, content binary"), "rows")
folder = stored.fresh(spark, "out")
files.write_files(rows, folder)
assert [r.text for r in files.documents(spark, folder, "*.txt").collect()] == ["x"]
assert stored.shared_folder(spark) == stored.shared_folder(spark)
print(folder)
"""


@pytest.mark.parametrize("scheme", [None, "", "file://"])
def test_shared_folder_with_and_without_a_scheme_and_unset(tmp_path, scheme):
    named = "" if scheme is None else f"{scheme}{tmp_path}/shared"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    run = subprocess.run([sys.executable, "-c", SHARED, named], env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.strip().startswith(f"file://{tmp_path}/shared/" if named else "file:///")
