"""Periodic runs against a scan of every period."""
import collections
import hashlib
import random
import zlib

import brute
import frames
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import periodic, queries


def all_runs(w, least=6):
    """(start, length, period) of all runs: for each period the maximal stretches in
    which words that far apart agree, without those that have a smaller period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 4 * q) and not any(
                    all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    """The words of the contract's input, by its formulas."""
    w = brute.words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected(doc_id, w):
    found = all_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.choice("abcde"[:rng.choice((1, 2, 2, 3, 5))]) for _ in range(rng.randrange(50))]
            for _ in range(rng.randrange(3)):
                at, base = rng.randrange(len(w) + 1), [rng.choice("abxyz") for _ in range(rng.randrange(1, 14))]
                w[at:at] = [base[i % len(base)] for i in range(rng.randrange(3, 7) * len(base) + rng.randrange(3))]
            texts.append(" ".join(w))
        words, found = periodic.batch_runs(texts)
        assert [[x.decode() for x in w] for w in words] == [t.split() for t in texts]
        assert found == [all_runs(t.split()) for t in texts]


def test_suffix_ranges_and_wavelet_matrix():
    rng = np.random.default_rng(5)
    codes = np.r_[rng.integers(0, 3, 300), 7]
    array, levels = periodic.suffix_ranges(codes.astype(np.int64))
    assert array.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    for k, (starts, lo, hi) in enumerate(levels):
        for x, a, b in zip(starts, lo, hi, strict=True):
            block = codes[x:x + 2 ** k].tolist()
            assert sorted(array[a:b]) == [i for i in range(len(codes)) if codes[i:i + 2 ** k].tolist() == block]
    tree = periodic.WaveletMatrix(array)
    lo = rng.integers(0, 150, 200)
    hi, x = lo + rng.integers(1, 150, 200), rng.integers(0, 301, 200)
    nth = tree.nth(lo, hi, (hi - lo) // 2)
    for a, b, v, less, mid in zip(lo, hi, x, tree.smaller(lo, hi, x), nth, strict=True):
        assert less == (array[a:b] < v).sum() and mid == np.sort(array[a:b])[(b - a) // 2]


def test_long_periods_and_long_texts():
    base = [f"w{k}" for k in range(5000)]
    words, found = periodic.batch_runs([" ".join(base * 4), "x " * 100_000, " ".join(base * 4 + ["end"] + base)])
    assert found == [[(0, 20_000, 5000)], [(0, 100_000, 1)], [(0, 20_000, 5000)]]
    assert periodic.collapsed(words[1], found[1]) == b"x" and len(periodic.collapsed(words[0], found[0]).split()) == 5000


@pytest.mark.parametrize("batch", [50, periodic.BATCH_WORDS])
def test_query_on_awkward_rows(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", batch)
    more = [(k, "a b a b a b a b c c c c c c c x y z " * (k % 5), "en", "s", 0, *frames.EXTRA) for k in range(600, 660)]
    rows = [r for r in frames.rows() if r[0] not in (13, 14)] + more
    df = frames.frame(spark, rows).withColumns({c: F.lit("x") for c in ("runs", "start", "period", "w", "n", "best")})
    got = periodic.digests(periodic.periodic_runs(queries.planted_runs(df))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected(r[0], planted(r[0], r[1])) for r in rows)
    plain = periodic.periodic_runs(df).filter("doc_id = 19 or doc_id = 7").orderBy("doc_id").collect()
    assert plain[0]["runs"] == [] and plain[0]["collapsed"] == "" and plain[1]["collapsed"] == "same line"
    assert periodic.digests(periodic.periodic_runs(frames.frame(spark, []))).count() == 0


def test_query_on_a_table(spark, sf001):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()}
    some = [d for d, t in docs.items() if len(t) < 6000]
    got = {r[0]: tuple(r) for r in queries.op13(spark, sf001).collect()}
    assert set(got) == set(docs) and sum(r[1] > 0 for r in got.values()) > 5
    assert {d: got[d] for d in some} == {d: expected(d, planted(d, docs[d])) for d in some}
