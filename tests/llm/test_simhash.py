"""SimHash groups against brute force over all pairs."""

import random

import pytest

import xxhash

from gaugewright.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_fingerprint(text):
    words = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                part[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((str(r[0]), f"{fps[i]:016x}", str(least.get(root(i)))) for i, r in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def made_rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "x", None) for i in range(60)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((1000 - i, " ".join(copy), None, "y"))
    rows += [(2000, None, "", ""), (2001, "", "", ""), (2002, " \t\r\n", "", ""), (5, "ÄÖ One\x0btwo three", "", ""), (5, "ÄÖ one two three", "", ""), (None, "only here is this text", "", ""), (None, " ".join(base), "", "")]
    return [*rows, (3000, "Many WORDS " * 30000, "", "")]


def test_made_rows_with_and_without_dense_lists(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert result(simhash.near_dedup(docs)) == want
    assert result(simhash.near_dedup(docs, posting_limit=2)) == want


@pytest.mark.parametrize("posting_limit", [0, 48])
def test_longer_keys_give_the_same_links(spark, posting_limit):
    rng = random.Random(9)
    words = [rng.getrandbits(64) for _ in range(200)]
    for base in words[:40]:
        for _ in range(10):
            words.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = sorted({w - (1 << 64) if w >> 63 else w for w in words})
    fps = spark.createDataFrame([(w,) for w in signed], "fp long")
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    for key_bytes in (3, 4):
        parts = {r.node: r.component for r in simhash.connected_components(simhash.fingerprint_links(fps, posting_limit, key_bytes)).collect()}
        assert all(parts.get(a, a) == parts.get(b, b) for a, b in want)
        assert set(parts) <= {x for pair in want for x in pair}


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(simhash.near_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
