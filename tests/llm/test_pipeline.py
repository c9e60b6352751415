import collections

import brute
import duckdb
import frames
import pytest

import corpus_pipeline
from tabsight.llm import mixing, quality
from tabsight.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, SF))
        out.append(docs)
    return [[tuple(r) for r in d.collect()] for d in out], [d.columns for d in out]


def test_stage_columns(stages):
    _, columns = stages
    assert len(corpus_pipeline.STAGES) == 5 and all(c == columns[0] for c in columns[:5])


def test_filter_stages_against_brute_force(spark, stages):
    (docs, good, unique, distinct, mixed, packed), _ = stages
    assert {r[0] for r in good} <= {r[0] for r in docs if not brute.quality(r[1])[-1]}
    assert len(good) > 0.8 * sum(not brute.quality(r[1])[-1] for r in docs)
    e = brute.exact([r[:2] for r in good])
    assert sorted(r[0] for r in unique) == sorted(d for d, x in e.items() if x[2])
    n, _ = brute.near([r[:2] for r in unique], 5)
    assert sorted(r[0] for r in distinct) == sorted(d for d, x in n.items() if x[2])


def test_mixing_and_packing_stages(stages):
    (_, _, _, distinct, mixed, packed), _ = stages
    sizes, taken, biggest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in distinct:
        n = len(brute.words(r[1]))
        sizes[r[3]] += n
        biggest[r[3]] = max(biggest[r[3]], n)
    for r in mixed:
        taken[r[3]] += len(brute.words(r[1]))
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)
    copies = collections.Counter(r[0] for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= {r[0] for r in distinct}
    assert collections.Counter(r[0] for r in packed if r[1] == 0) == copies
    room = collections.Counter()
    for r in packed:
        room[r[5]] += r[3]
    assert max(room.values()) <= 2048


def test_run_takes_awkward_tables(spark, tmp_path):
    for some in (None, []):
        folder = tmp_path / ("empty" if some is not None else "odd")
        frames.frame(spark, some).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[0] == "doc_id" and (out.count() > 0) == (some is None)


def test_query_of_exact_dedup_against_its_sql(spark):
    got = sorted(map(tuple, QUERIES["op2_exact_dedup"](spark, SF).collect()))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(c.sql(ORACLE["op2_exact_dedup"]).fetchall())


def test_every_operator_has_its_query():
    assert [n for n in QUERIES if n.startswith("op")] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert len(QUERIES) == 10 and mixing and quality
