import collections

import brute
import frames
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import exact_dedup, near_dedup


def test_chunk_hashes_combine():
    rng = np.random.default_rng(0)
    for p in exact_dedup.MODULI:
        x, y = rng.bytes(777), rng.bytes(1234)
        table = (exact_dedup.powers(4000, p), p)
        whole = 0
        for b in x + y:
            whole = (whole * exact_dedup.BASE + b) % p
        assert exact_dedup.chunk_hash(x + y, table) == whole
        parts = [exact_dedup.chunk_hash(z, table) for z in (x, y)]
        assert exact_dedup.combine(*parts, len(y), p) == whole
    assert exact_dedup.chunk_hash(b"", table) == 0


def _exact(out):
    return sorted(((r["doc_id"] is None, r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect())


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, (3, 5)])  # tiny moduli: groups of differing texts
@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_exact_duplicates(spark, moduli, chunk):
    rows = frames.rows()
    got = exact_dedup.exact_duplicates(frames.frame(spark), chunk, moduli).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(brute.FOLD)].append(r[0])
    assert len(got) == len(rows)
    by_sha = collections.defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    assert len(by_sha) == len(groups)
    import hashlib
    for text, ids in groups.items():
        mine = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        assert {r["keep_id"] for r in mine} == {keep} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]


def test_exact_kept_rows_and_empty(spark):
    df = frames.frame(spark)
    kept = exact_dedup.kept_rows(df, exact_dedup.exact_duplicates(df))
    assert kept.columns == df.columns
    texts = [(r["text"] or "").translate(brute.FOLD) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(brute.FOLD) for r in frames.rows()})
    empty = frames.frame(spark, [])
    assert exact_dedup.kept_rows(empty, exact_dedup.exact_duplicates(empty)).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    rows = [r for r in frames.rows() if r[0] is not None and r[0] != 30]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in near_dedup.near_duplicates(frames.frame(spark, rows), words).collect()}
    want, links = brute.near([(r[0], r[1]) for r in rows], words)
    assert links > 100 and got == want


def test_near_duplicates_nulls_repeats_and_empty(spark):
    got = near_dedup.near_duplicates(frames.frame(spark), 5).collect()
    assert len(got) == len(frames.rows())
    assert [r["kept"] for r in got if r["doc_id"] == 30].count(True) == 1
    assert {r["component_id"] for r in got if r["doc_id"] == 30} == {30}
    same = [r for r in got if r["doc_id"] in (5, 6) or r["doc_id"] is None and r["n_shingles"] == 86]
    assert len(same) == 3 and {r["component_id"] for r in same} == {5}  # a null id never names a group that has another
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert near_dedup.near_duplicates(frames.frame(spark, []), 5).count() == 0


def test_table_keys_pair_the_bands():
    half, width = 10, 2
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.unique(np.r_[sets[0][:460], sets[1][:40]]))
    band = near_dedup.bands(sets, half, width)
    keys = near_dedup.table_keys(band, half)
    assert band.shape == (3, 2 * half) and keys.shape == (3, half * half)
    for i in range(half):
        for j in range(half):
            agree = band[0, i] == band[2, i] and band[0, half + j] == band[2, half + j]
            assert agree == (keys[0, i * half + j] == keys[2, i * half + j])
    assert len(np.unique(keys)) >= 2 * half * half


def test_recall_of_the_tables_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 450, dtype=np.uint64)
        a, b = np.unique(x[:400]), np.unique(x[50:])  # 350 of 450 shared: 0.78
        keys = near_dedup.table_keys(near_dedup.bands([a, b], 10, 2), 10)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 399


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, k) for k in range(1001, 1300)]
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(chain + star + [(5, 5)], "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1300)}}
    assert near_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixed_buckets_lose_no_link(spark):
    """Documents of one boilerplate meet in buckets though few are linked."""
    base = frames.prose(300, 77)
    rows = []
    for k in range(60):
        own = frames.prose(60, 7000 + k // 2)
        tail = "" if k % 2 else " tail"
        rows.append((k, base + " " + own + tail, "en", "s", 0, *frames.EXTRA))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frames.frame(spark, rows), 4).collect()}
    want, _ = brute.near([(r[0], r[1]) for r in rows], 4)
    assert got == {d: w[1] for d, w in want.items()}


def test_large_group_of_edited_copies(spark):
    """One base text edited more and more: few of the pairs are links."""
    base = frames.prose(150, 5)
    rows = [(k, frames.near_copy(base, k % 15, 900 + k), "en", "s", 0, *frames.EXTRA) for k in range(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frames.frame(spark, rows), 4).collect()}
    want, links = brute.near([(r[0], r[1]) for r in rows], 4)
    assert got == want and 1000 < links < 300 * 299 / 4


def test_neighbours_across_partition_borders(spark):
    """Each bucket is one tree, whatever partitions it lies in; rows of one component give no pair."""
    keys = spark.range(2000).select((F.col("id") % 3).alias("key"), F.col("id").alias("cid"), F.lit(7).alias("n"), F.col("id").alias("comp"),
                                    F.lit(1).alias("i"), F.lit(1).alias("j"))
    pairs = near_dedup._neighbours(keys).collect()
    assert len(pairs) == 2000 - 3 and all((r["u"] - r["v"]) % 3 == 0 and (r["nu"], r["nv"], r["own"]) == (7, 7, 1) for r in pairs)
    assert {r["v"] for r in pairs} | {0, 1, 2} == set(range(2000)) and all(r["u"] < r["v"] for r in pairs)
    joined = near_dedup._neighbours(keys.withColumn("comp", F.expr("cid div 1000"))).collect()
    assert joined and all(r["u"] // 1000 != r["v"] // 1000 for r in joined)


def test_kept_rows_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c", s, k) for s in ("s1", "s2", None) for k in (1, 2)] + [(2, "A b c", "s9", 0)] + [(None, None, "s", 1), (None, "", "s", 1)]
    schema = "doc_id long, text string, source string, kept long"
    runs = []
    for parts in (1, 4, 7):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        kept = exact_dedup.kept_rows(df, exact_dedup.exact_duplicates(df))
        assert kept.columns == df.columns
        runs.append(sorted(map(str, (tuple(r) for r in kept.collect()))))
        near = exact_dedup.kept_rows(df, near_dedup.near_duplicates(df, words=2)).collect()
        assert sum(r["doc_id"] == 1 for r in near) == 1
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2


def test_rounds_of_stars_have_other_tables_and_firsts(spark):
    """A round of shifted tables takes the tables (i, i + shift) only, and a seed another first class a bucket."""
    rng = np.random.default_rng(4)
    bands = [rng.integers(0, 9, 6, dtype=np.uint64).tobytes() for _ in range(20)]
    classes = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bands)], "cid long, __bands binary")
    every = {tuple(r) for r in near_dedup._key_rows(classes, 3).collect()}
    some = {tuple(r) for r in near_dedup._key_rows(classes, 3, (), 0, 2).collect()}
    assert some == {r for r in every if (r[2] + 2) % 3 == r[3]} and len(some) == 60
    keys = spark.range(400).selectExpr("id as cid", "id + 10 as n", "id as comp", "id % 8 as key", "cast(0 as byte) as i", "cast(1 as byte) as j")
    for seed in (0, 1):
        got = near_dedup._neighbours(keys, seed).collect()
        assert len(got) >= 392 and all(r["u"] % 8 == r["v"] % 8 and r["nu"] == r["u"] + 10 and r["own"] == -1 for r in got)
        assert {r["u"] for r in got} >= set(range(8)) if not seed else len({r["u"] for r in got} - set(range(8)))


def test_texts_near_the_limit_are_joined_by_rounds(spark, monkeypatch):
    """Many texts around 0.8 of one another: rounds of stars leave fewer pairs to the last step, with the same groups."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(120, 3, replace=False):
            words[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    seen, across, groups = [], near_dedup._across, []
    monkeypatch.setattr(near_dedup, "_across", lambda *a: seen.append((x := across(*a)).count()) or x)
    for few in (1, 10 ** 9):  # at most one round; all of them
        monkeypatch.setattr(near_dedup, "FEW", few)
        groups.append(sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=4).collect()))
    sets = [set(zip(*[t.split()[k:] for k in range(4)], strict=False)) for t in texts]
    low = list(range(60))
    for _ in range(60):
        low = [min(low[j] for j in range(60) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(60)]
    assert groups[0] == groups[1] == list(enumerate(low)) and seen[1] <= seen[0]
