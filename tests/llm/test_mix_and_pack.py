import collections

import brute
import frames
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsight.llm import mixing, packing
from tabsight.llm.common import rank_within, written
from tabsight.llm.queries import byte_bpe


def test_targets(spark):
    sizes = {"b": 1000, "a": 10, "é": 500, "Z": 300, None: 40, "empty": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6
    with pytest.raises(ValueError):
        mixing.source_targets(df, share=3.0)


def test_meet_keeps_mass_and_leaves_one_open():
    import random
    for seed in range(50):
        rng = random.Random(seed)
        p = [rng.random() for _ in range(101)]
        q = list(p)
        left = mixing._meet(q, rng.random)
        assert abs(sum(p) - sum(q)) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(q) if i != left)


def test_meet_is_unbiased():
    import random
    p, n = [0.2, 0.7, 0.5, 0.6], 20000
    rng = random.Random(3)
    total = [0.0] * 4
    for _ in range(n):
        q = list(p)
        mixing._meet(q, rng.random)
        total = [a + b for a, b in zip(total, q)]
    assert all(abs(t / n - x) < 0.015 for t, x in zip(total, p))


@pytest.mark.parametrize("block, fan_in", [(1024, 64), (8, 2)])
def test_mix(spark, block, fan_in):
    rows = frames.rows()
    runs = []
    for parts in (2, 5):
        out = mixing.mix(frames.frame(spark, parts=parts), block=block, fan_in=fan_in).collect()
        runs.append(sorted((str(r["doc_id"]), r["__h1"], r["size"], r["copies"]) for r in out))
    assert runs[0] == runs[1]  # the partitioning has no say
    sizes, biggest = collections.Counter(), collections.Counter()
    for d, t, _, s, *_ in rows:
        sizes[s] += len(brute.words(t))
        biggest[s] = max(biggest[s], len(brute.words(t)))
    want = brute.targets(sizes)
    taken = collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)


def test_mixed_rows_and_empty(spark):
    df = frames.frame(spark)
    copies = collections.Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"], r["__h1"]] += r["copies"]
    got = collections.Counter((r["doc_id"], r["h"]) for r in mixing.mixed_rows(df).select("doc_id", F.xxhash64("text").alias("h")).collect())
    assert got == collections.Counter({k: n for k, n in copies.items() if n})
    assert mixing.mixed_rows(df).columns == df.columns
    assert mixing.mixed_rows(frames.frame(spark, [])).count() == 0


def test_rank_within(spark):
    df = written(spark.range(1000).select((F.col("id") % 7).cast("long").alias("g"), F.floor(F.col("id") / 50).alias("v"), "id"))
    got = rank_within(df, "g", [F.col("v")]).collect()
    for g in range(7):
        mine = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_plan_is_best_fit():
    import random
    rng = random.Random(1)
    counts = collections.Counter(rng.randint(1, 64) for _ in range(3000))
    rows = packing.plan(counts, 64)
    bins, seen = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, per, offset in rows:
        assert rank == seen[length]
        seen[length] += n
        for t in range(n):
            bins[first + t // per].append((offset + t % per * length, length))
    assert seen == counts
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    # best-fit decreasing piece by piece
    room = []
    for length in sorted(counts.elements(), reverse=True):
        fit = min((r for r in room if r >= length), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((64 if fit is None else fit) - length)
    assert len(bins) == len(room)
    assert packing.plan({}, 8) == []


def test_encoder_ways_agree():
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = byte_bpe()
    texts = ["", " ", "a  b\n\n c\t", "Élève über ñandú ß €5 „quote“ it's we'll 1234 don’t", "<|endoftext|>", "x<|endoftext|>y", "日本語 текст 😀",
             "z" * 3000, " " * 3000, frames.prose(500, 3), "\x00\x1f\x7f\x85\xa0 a", "²½ ªº ʰ", "a b c​d"]
    texts += [chr(c) + "a " + chr(c) + chr(c) for c in [*range(0x250), *range(0x2010, 0x205F)]]
    for t in texts:
        assert enc(t) == slow.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_pack(spark):
    rows = frames.rows()
    got = packing.pack(frames.frame(spark), byte_bpe, capacity=256, keep_ids=True).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = brute.token_pieces([(k, r[1]) for k, r in enumerate(rows)], tok, 256)
    assert collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == \
        collections.Counter((k[1], *v) for k, v in want.items())
    bins = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(frames.frame(spark, []), byte_bpe).count() == 0


def test_mixed_rows_keep_source_and_other_columns(spark):
    """Rows that differ only in source, or only in an extra column, stay what they are."""
    rows = [(1, "a b c d e", s, x) for s in ("s1", "s2", None) for x in ("x", "y", "y", None)] + [(None, "f g", "s1", "z")] * 5 \
        + [(k, f"w{k} " * 6, "s2", "x") for k in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string").repartition(4)
    decided = collections.Counter()
    for r in mixing.mix(df).collect():
        decided[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = [tuple(r) for r in mixing.mixed_rows(df).collect()]
    assert collections.Counter((d, s, len(t.split())) for d, t, s, _ in got) == collections.Counter({k: n for k, n in decided.items() if n})
    assert set(got) <= set(rows)
    for s in ("s1", "s2", None):  # four rows share the copies evenly
        counts = collections.Counter(r[3] for r in got if r[0] == 1 and r[2] == s)
        total = sum(counts.values())
        assert all(total // 4 * n <= counts[x] <= -(-total // 4) * n for x, n in (("x", 1), ("y", 2), (None, 1)))
    again = [tuple(r) for r in mixing.mixed_rows(df.repartition(7)).collect()]
    assert collections.Counter(got) == collections.Counter(again)
