"""Records over line breaks, read by byte ranges, against a reader of the whole text."""
import random

import pytest

from tabsight.sources import csv_ranges, ingest


def whole(text):
    """All records of a text by a character machine."""
    out, record, field, state = [], [], "", "start"
    for c in text + "\n":
        if state == "quoted":
            if c == '"':
                state = "closing"
            else:
                field += c
            continue
        if state == "closing" and c == '"':
            field, state = field + '"', "quoted"
        elif c == "\n":
            if state == "plain" or state == "start":
                field = field.removesuffix("\r")
            elif field.endswith("\r") and state == "after":
                field = field[:-1]
            if record or field or state in ("closing", "after"):
                out.append([*record, field])
            record, field, state = [], "", "start"
        elif c == ",":
            record, field, state = [*record, field], "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            if state == "closing" and c == "\r":
                continue
            field, state = field + c, "plain" if state in ("start", "plain") else "after"
    return out


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few dozen bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.random()
    plain = "".join(rng.choice('ab c5é') for _ in range(rng.randrange(1, 6)))
    if kind < 0.4:
        return plain
    if kind < 0.5:
        return plain + '" x"y'  # quotes in a plain field
    inner = "".join(rng.choice(['a', ',', '\n', '\n', '""', '\r\n', ' ', '""\n']) for _ in range(rng.randrange(12)))
    return f'"{inner}"' + (rng.choice(["", "", "z", 'z"']))


def file_text(seed, rows, width=3):
    rng = random.Random(seed)
    lines = ["k,s,t"] + [",".join([str(i), *[field(rng) for _ in range(width - 1)]]) for i in range(rows)]
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_records_of_any_ranges(spark, tmp_path, small_ranges, size):
    texts = [file_text(seed, 40) for seed in range(3)]
    for i, t in enumerate(texts):
        (tmp_path / f"part-{i}.csv").write_bytes(t.encode())
    small_ranges(size)
    text = ingest._records_text(spark, str(tmp_path), None, True)
    assert text.columns == ["k", "s", "t"]
    want = [tuple((r + [None] * 3)[:3]) for t in texts for r in whole(t)[1:]]
    assert sorted(map(str, (tuple(r) for r in text.collect()))) == sorted(map(str, want))
    if size < 100:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text('id,s\n1,"' + "line, with \"\"quotes\"\"\n" * 200 + '"\n2,5" pipe\n3,"' + "\n" * 90 + '"\n4,end')
    small_ranges(64)
    got = {r["id"]: r["s"] for r in ingest.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True).collect()}
    assert got == {1: 'line, with "quotes"\n' * 200, 2: '5" pipe', 3: "\n" * 90, 4: "end"}


def test_without_broadcast(spark, tmp_path, small_ranges):
    text = file_text(9, 60)
    (tmp_path / "x.csv").write_bytes(text.encode())
    small_ranges(50)
    spark.conf.set("tabsight.broadcastBytes", "320")
    try:
        got = ingest._records_text(spark, str(tmp_path), None, True).collect()
    finally:
        spark.conf.unset("tabsight.broadcastBytes")
    assert sorted(r["k"] for r in got) == sorted(r[0] for r in whole(text)[1:])


def test_awkward_files(spark, tmp_path, small_ranges):
    small_ranges(16)
    (tmp_path / "empty.csv").write_text("")
    assert ingest._records_text(spark, str(tmp_path / "empty.csv"), None, True).count() == 0
    (tmp_path / "head.csv").write_text('﻿"a\nb",c\n\n\r\n"x",\n,""\n1\n1,2,3\n')
    df = ingest._records_text(spark, str(tmp_path / "head.csv"), None, True)
    assert df.columns == ["a\nb", "c"]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [("x", ""), ("", ""), ("1", None), ("1", "2")]))
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(csv_ranges.UnbalancedQuote):
        ingest.read_csv(spark, str(tmp_path / "open.csv"), multi_line=True)


def test_a_quote_in_a_plain_field_by_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,s\n1,5" pipe\n2,"a ""b"" c"\n3,x\n')
    got = {r["id"]: r["s"] for r in ingest.read_csv(spark, str(tmp_path / "q.csv")).collect()}
    assert got == {1: '5" pipe', 2: 'a "b" c', 3: "x"}


def test_state_functions():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice('a",\n""') for _ in range(rng.randrange(30)))
        for inside in (False, True):
            state = inside
            for line in text.split("\n"):
                state = csv_ranges.ends_inside(line, state)
            machine = "quoted" if inside else "start"
            for c in text:
                if machine == "quoted":
                    machine = "closing" if c == '"' else "quoted"
                elif machine == "closing" and c == '"':
                    machine = "quoted"
                elif c in ",\n":
                    machine = "start"
                else:
                    machine = "quoted" if c == '"' and machine == "start" else "plain"
            assert state == (machine == "quoted"), (text, inside)
