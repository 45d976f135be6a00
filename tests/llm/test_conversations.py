"""The conversation trie against brute force over whole sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugewright.llm import conversations, oracles
from gaugewright.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plan():
    return F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4


def sequences(rows, swap=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    if not swap:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def brute(seqs):
    members = defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    inner = {n[:-1] for n in members if n}
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * words(n)
            leaves[n[:d]] += n not in inner
        if n:
            children[n[:-1]] += 1
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(n))
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def planted():
    """Shared starts, equal conversations, null roles, texts and turns, repeated rows, long texts and long conversations."""
    pick, rows = random.Random(5), []
    for c in range(140):
        n = pick.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, pick.choice(["user", "bot", None]), pick.choice(["", None, "a b", "c d e", " x\ty\n"])) for t in range(n)]
    rows += [(c, t, "user", f"hello {t}") for c in range(200, 280) for t in range(4)]  # a hot, equal group
    rows += [(c, t, "user", f"turn {min(t, c - 298)} of many") for c in (300, 301, 302, 320, 321) for t in range(12)]
    rows += [(400, None, "user", "first"), (400, 3, "a", "late"), (400, None, "user", "first"), (400, 3, "a", "late"), (None, 1, "user", "nobody"), (401, 0, "user", "x " * 50_000), (777, 0, None, None)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("swap", [True, False])
def test_against_brute_force(spark, swap):
    rows = planted()
    steps = conversations.rebuilt(spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "key": F.lit("x"), "node": F.lit(2)}), *(plan() if swap else ()))
    assert rows_of(conversations.trie(steps)) == brute(sequences(rows, swap))


def test_sequences_that_only_meet_late(spark):
    """Levels go on as long as different conversations share turns; one conversation that begins another is no leaf."""
    rows = [(c, t, "u", f"{t}") for c in (1, 2, 3) for t in range(6)] + [(3, 6, "u", "more"), (1, 6, "v", "other")]
    assert rows_of(conversations.trie(conversations.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(sequences(rows, False))


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.trie(conversations.rebuilt(none, *plan())).collect() == []
    alone = [(c, 0, "u", "x") for c in (21, 22, 23, 24, 25, 26)]
    assert rows_of(conversations.trie(conversations.rebuilt(spark.createDataFrame(alone, SCHEMA), *plan()))) == brute(sequences(alone))


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(op12_conversation_trie(spark, "/root/testdata/sf0.001")) == brute(sequences([tuple(r) for r in rows]))


def test_oracle_against_brute_force():
    import duckdb
    import pandas as pd

    rows = [r for r in planted() if r[0] is None or r[0] < 400]
    duck = duckdb.connect()
    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(duck.sql(oracles.CONVERSATION_TRIE).select(*names).fetchall()) == brute(sequences(rows))
