"""Hard negatives, periodic runs and min-hash near copies against plain Python and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import SF, assert_same  # noqa: E402

from rasterspark.llm import hard_negatives, minhash_dedup, periodic_runs  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = (None, "", " \n ", "word", "a b c", "A b C", "c b a", "Été\x00x ßtraße 123 a b c d", "long " * 30_000, "one two three four five six", "one two three four five six")


@pytest.mark.parametrize("scale", [1, 4, 1e4, 1e6, 1e9, 1e300])
@pytest.mark.parametrize("dim", [1, 64])
def test_packed_products_are_exact(scale, dim):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(40, dim)) * scale
    with np.errstate(over="ignore"):
        norm = float(np.max(((256 * np.abs(values) + 1) ** 2).sum(1)))
    packing = hard_negatives.Packing.of(dim, float(np.abs(values).max()), norm)
    parts = packing.components(values)
    exact = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in parts[17:]] for a in parts[:17]]
    assert packing.scores(parts[:17], packing.words(parts[17:]), 23).tolist() == exact
    assert packing.fields > 1 or scale > 4


def test_hard_negatives_edges(spark, monkeypatch):
    """Ties, repeated rows and ids, nulls, ragged vectors, clashing columns; blocks and slots of a few rows."""
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=5).round(1)], int(rng.integers(0, 3))) for k in range(400)]
    rows += rows[:3] + rows[100:104] + [(100, [1.0] * 5, 1), (200, [0.5, 0.5], 2), (200, [0.5, 0.5], 1), (7, [], 1), (300, [0.0] * 5, 0)]
    rows += [(None, [1.0] * 5, 1), (500, None, 1), (600, [1.0, None, 1.0, 1.0, 1.0], 1), (700, [float("nan")] * 5, 1), (800, [float("inf")] * 5, 1), (900, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("number", "block", "slot", "score", "id")})
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "SLOT", 50)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    found = hard_negatives.mine_negatives(hard_negatives.labelled_vectors(df))
    assert_same(found, hard_negatives.ORACLE, con)
    assert found.count() > 100
    assert hard_negatives.mine_negatives(hard_negatives.labelled_vectors(df.limit(0))).count() == 0


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_against_all_periods():
    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 6)
            words = [w if i < a + p else words[a + (i - a) % p] for i, w in enumerate(words)] + words[:5]
        assert periodic_runs.runs_of(np.array(words, np.int64)) == plain_runs(words)
    a, b = [0], [0, 1]  # a Fibonacci word has cubes but no fourth powers
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic_runs.runs_of(np.array(b)) == []
    assert periodic_runs.runs_of(np.tile(np.arange(700), 50)) == [(0, 35000, 700)]


def plain_digests(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if len(set(words)) > 1 or not words else [(0, n, 1)] * (n >= 6)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    s, size, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), s, size, q, 1000 * size // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query(spark, tmp_path):
    cut = "x y " * 9 + "z " + "p q r " * 5 + "tail"
    texts = [*EDGE, cut, "a a a a a a b b b b b b", "a a a a a", "u v " * 3 + "u"]
    planted = [(k, f"word{k} " + " ".join(f"w{i % 17} v{i}" for i in range(40))) for k in range(100, 160)]
    rows = [*enumerate(texts), *planted, *planted[:2], (None, cut)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `runs` string").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic_runs.query(spark, str(tmp_path))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in out.collect()), key=str) == sorted(((d, *plain_digests(d, t)) for d, t in rows), key=str)
    assert out.limit(0).count() == 0 and periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_runs_on_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: tuple(r)[1:] for r in periodic_runs.query(spark, SF).collect()}
    assert len(out) == len(rows)
    for r in rows:
        if len(r.text or "") < 20_000:
            assert out[r.doc_id] == plain_digests(r.doc_id, r.text), r.doc_id


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for x in sets[d]:
            for e in having[x]:
                shared[e] += 1
            having[x].append(d)
        for e, n in shared.items():
            if 100 * n >= 85 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def near_texts():
    rng = random.Random(11)
    names = [f"W{i}" for i in range(4000)]
    fresh = lambda n: [rng.choice(names) for _ in range(n)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(names)
        return words

    base, passage, chain, rows = fresh(200), fresh(100), fresh(150), []
    rows += [edited(base, rng.randint(0, 5)) for _ in range(260)]  # a group whose sets follow a pivot
    rows += [passage + fresh(rng.randint(5, 90)) for _ in range(150)]  # a passage that unlike texts share
    for _ in range(60):
        chain = edited(chain, rng.randint(1, 3))
        rows.append(chain)
    for _ in range(30):
        one = fresh(rng.randint(6, 90))
        rows += [edited(one, rng.randint(0, 3)) for _ in range(rng.randint(2, 5))]
    texts = [" ".join(r) for r in rows] + list(EDGE)
    rng.shuffle(texts)
    return texts


def test_minhash_components_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "NODE", 64)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 50)
    monkeypatch.setattr(minhash_dedup, "FOLLOWERS", 20)
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `set` string, print string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(df).collect()}
    assert out == plain_components(rows)


def test_minhash_edges(spark):
    long = "long text " + " ".join(f"w{i}" for i in range(40_000))
    rows = [(3, "a b c d e f g"), (3, "x y"), (None, "a B c d e f g"), (None, "p q r s t u"), (None, "p q r s t u"), (5, None), (5, ""), (9, long), (8, long)]
    out = minhash_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(3, 3, 3, True), (3, 1, 3, True), (None, 3, 3, False), (None, 2, None, True), (None, 2, None, True), (5, 0, 5, True), (5, 0, 5, True), (9, 39_998, 8, False), (8, 39_998, 8, True)], key=str
    )
    assert minhash_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_plan():
    plan = minhash_dedup.Plan((85, 100), 0.9999)
    assert plan.missed(0.85) <= 0.5e-4 and 2 * plan.side * minhash_dedup.HALF == plan.places < 2 * minhash_dedup.HALF * plan.side**2
    assert 0 < plan.meet < plan.fringe < plan.least <= plan.core < plan.places
