"""Spelling variants against the comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from gaugewright.llm import oracles, spelling
from gaugewright.llm.queries import op11_spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_near(words):
    """All near words of each, by the words without one code point."""
    words = sorted(set(words))
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    found = {w: set() for w in words}
    for group in by.values():
        for w in group:
            found[w] |= {x for x in group if x != w}
    for w in words:
        for i in range(len(w)):
            if (shorter := w[:i] + w[i + 1 :]) in found:
                found[w].add(shorter)
                found[shorter].add(w)
    return found


def brute(n):
    links = all_near(n)
    form = {}
    for w, xs in links.items():
        best = min(xs, key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_pairs_against_all_pairs(spark):
    pick = random.Random(3)
    words = {"".join(pick.choices("abé", k=pick.randint(0, 7))) for _ in range(150)} | {"", "a", "aa", "aaa", "aaaa", "ab", "ba", "ß", "😀a", "😀b", "😀ab"}
    for size in (23, 24, 25, 26, 27, 48, 49, 50, 75, 200):  # around the windows' bounds
        w = "".join(pick.choices("ab", k=size))
        words |= {w, *(w[:i] + w[i + 1 :] for i in (0, 1, size // 2, size // 3, size - 2, size - 1)), *(w[:i] + "c" + w[i:] for i in (0, 11, 12, size // 2, size)), *(w[:i] + "d" + w[i + 1 :] for i in (0, size // 2, size - 1)), "a" * size}
    words = sorted(words)
    want = sorted((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b))
    got = spelling.near_words(spark.createDataFrame([(w, 1) for w in [*words, None]], "word string, node int")).collect()
    assert sorted((r.a, r.b) for r in got) == want


def test_forms_roots_and_ties(spark):
    n = {"colour": 100, "color": 50, "colur": 3, "colr": 1, "xolour": 100, "aaaaa": 4, "aaaab": 8, "aaaac": 8, "aaabb": 16, "lonely": 5}
    table = spark.createDataFrame([*n.items(), (None, 9)], "word string, n long")
    assert rows_of(spelling.variants(table)) == brute(n)
    assert spelling.variants(table.where("false")).collect() == []


def test_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "Ábc ÀB×c, d1e_FĀg", "x"), (2, None, "x"), (None, "", "x"), (2, "ZZ", "x"), (2, "ZZ", "x")], "doc_id long, text string, word string")
    assert sorted(r.word for r in spelling.words(docs).collect()) == sorted(["Ábc", "Àb×c", "d", "e", "f", "g", "zz", "zz"])
    assert spelling.vocabulary(spelling.words(docs), 2, 2).collect()[0].asDict() == {"word": "zz", "n": 2}


def counts():
    n = Counter()
    for doc_id, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_query_on_the_whole_table(spark):
    assert rows_of(op11_spelling(spark, "/root/testdata/sf0.001")) == brute(counts())


def test_oracle_against_brute_force():
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(duck.sql(oracles.SPELLING).select("word", "form", "root", "n", "n_near", "form_n").fetchall()) == brute(counts())


def test_null_id_of_a_text(spark):
    from gaugewright.llm.queries import _misspelt

    docs = spark.createDataFrame([(None, "alpha")], "doc_id long, text string")
    assert spelling.words(docs, _misspelt()).where(F.col("word").isNotNull()).count() == 1
