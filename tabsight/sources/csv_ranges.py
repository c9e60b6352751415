"""CSV records that may run over several lines, read by byte ranges in parallel.

Spark splits a text file into byte ranges and gives each range its whole lines. What a
line means depends on one bit: whether it begins inside a quoted field. A range's lines
turn that bit at their begin into the bit at their end, a function of two values, so

1. one scan finds the function of each range from both states (a line without a quote
   leaves the bit alone),
2. the functions before a range are composed in the order of the file, by a window over
   one row a range: the last range that fixes the bit, turned by the later ones that flip it,
3. a second scan parses every range from its true state. Records that cross range borders
   come out as pieces, which are put together by file and place.

A quote opens a quoted field only at the field's start; elsewhere in a plain field, and
after a closing quote, it is a character like any other. Two quotes inside a quoted field
are one. Records end with a line feed, with or without a carriage return; empty ones are
skipped."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_row_limit, ship_package

#: The fields of a line from a field's start on, as far as all their quotes are closed.
CLOSED = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)(?:,|\Z))*+', re.S)
#: The rest of a quoted field, with what follows up to the next comma.
REST = re.compile(r'(?:[^"]|"")*+"(?!")[^,]*+(?:,|\Z)', re.S)
FIELD = re.compile(r'"((?:[^"]|"")*+)"([^,]*+)|([^,]*+)', re.S)

TAIL, HEAD, MIDDLE = 0, 1, 2


class UnbalancedQuote(ValueError):
    """A quoted field of a CSV file isn't closed where it has to be."""


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, if one was at its begin or not."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        rest = REST.match(line)
        if not rest:
            return True
        at = rest.end()
        if line[at - 1] != ",":
            return False
    return CLOSED.match(line, at).end() < len(line)


def fields(record: str) -> list[str]:
    """The fields of one record, without quotes around them."""
    record = record.removesuffix("\r")
    if '"' not in record:
        return record.split(",")
    out, at = [], 0
    while True:
        m = FIELD.match(record, at)
        out.append(m[3] if m[1] is None else m[1].replace('""', '"') + m[2])
        at = m.end() + 1
        if at > len(record):
            return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of each byte range, in their order inside a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches):
    """((file, start), lines of this batch) for each range in turn."""
    for b in batches:
        values, files, starts = (b.column(c).to_pylist() for c in ("value", "file", "start"))
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or starts[i] != starts[at] or files[i] != files[at]:
                yield (files[at], starts[at]), range(at, i), values, b
                at = i


def _functions(lines: DataFrame) -> DataFrame:
    """(file, start, from_out, from_in): the state that each range ends in, from either state."""
    def run(batches):
        import pyarrow as pa
        out, last, state = [], None, (False, True)
        for key, rows, values, _ in _ranges(batches):
            if key != last and last is not None:
                out.append((*last, *state))
                state = (False, True)
            last = key
            for i in rows:
                if '"' in values[i]:
                    a = ends_inside(values[i], state[0])
                    state = (a, a if state[0] == state[1] else ends_inside(values[i], state[1]))
        if last is not None:
            out.append((*last, *state))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
            names=["file", "start", "from_out", "from_in"])

    return lines.mapInArrow(run, "file string, start long, from_out boolean, from_in boolean")


def _begins(functions: DataFrame) -> DataFrame:
    """(file, start, inside, ends): the true state at the begin and end of each range."""
    order = Window.partitionBy("file").orderBy("start")
    fixed, flips = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    turned = functions.withColumn("flips", F.sum(flips.cast("int")).over(order))
    last = F.last(F.when(fixed, F.struct("from_out", "flips")), ignorenulls=True).over(order)
    # after the range: what the last fixing range says (outside before any), turned by the flips since
    ends = (F.coalesce(last["from_out"], F.lit(False)).cast("int") + F.col("flips") - F.coalesce(last["flips"], F.lit(0))) % 2 == 1
    return turned.withColumn("ends", ends).withColumn("inside", F.lag("ends", 1, False).over(order)).select("file", "start", "inside", "ends")


def _parsed(lines: DataFrame) -> DataFrame:
    """(fields, first, file, start, kind, text) of ``lines`` (value, file, start, inside):
    a row for each record inside one range (kind null) and for each piece of another;
    ``first`` marks the first record of a file."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("fields", pa.list_(pa.string())), ("first", pa.bool_()), ("file", pa.string()),
                            ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
        out, size = [], 0
        last, held, open_, tail, top = None, [], False, False, False

        def close():
            # a range's last record goes on in the next one
            if held:
                out.append((None, top, *last, MIDDLE if tail else HEAD, "\n".join(held) + "\n"))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for key, rows, values, b in _ranges(batches):
            if key != last:
                close()
                open_ = tail = b.column("inside")[rows[0]].as_py()
                last, held, top = key, [], key[1] == 0
            for i in rows:
                line = values[i]
                if open_ or '"' in line:
                    held.append(line)
                    open_ = ends_inside(line, open_)
                    if open_:
                        continue
                    text = "\n".join(held) if len(held) > 1 else line
                    held = []
                    if tail:
                        out.append((None, False, *key, TAIL, text))
                        tail = False
                        continue
                else:
                    text = line
                if text and text != "\r":
                    out.append((fields(text), top, *key, None, None))
                    size += len(text)
                    top = False
            if size > 4_000_000 or len(out) > 20_000:
                yield batch()
                out, size = [], 0
        close()
        yield batch()

    return lines.mapInArrow(run, "fields array<string>, first boolean, file string, start long, kind int, text string")


def _whole(pieces: DataFrame) -> DataFrame:
    """(fields, first) of the records that ``pieces`` make up, by file and place."""
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == HEAD)  # two pieces a range at most
    record = F.sum((F.col("kind") == HEAD).cast("int")).over(order)
    whole = pieces.withColumn("record", record).groupBy("file", "record").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([fields(t) for t in b.column("text").to_pylist()], pa.list_(pa.string())), b.column("first")], names=["fields", "first"])

    return whole.select("text", "first").mapInArrow(run, "fields array<string>, first boolean")


def read_records(spark: SparkSession, path: str, written) -> DataFrame:
    """(fields, first) of all records of the CSV files at ``path``; ``first`` marks the
    first of each file. ``written`` stores a small table and reads it back.

    A file that ends inside a quoted field raises ``UnbalancedQuote``. An empty file has no
    records. Records come in no particular order."""
    ship_package(spark)
    lines = _lines(spark, path)
    begins = written(_begins(_functions(lines)))
    after = Window.partitionBy("file").orderBy(F.col("start").desc())
    open_ = begins.withColumn("at", F.row_number().over(after)).where("at = 1 and ends").limit(1).collect()
    if open_:
        raise UnbalancedQuote(f"{open_[0]['file']} ends inside a quoted field")
    state = begins.select("file", "start", "inside")
    if begins.count() <= broadcast_row_limit(spark):  # a row for each range
        placed = lines.join(F.broadcast(state), ["file", "start"])
    else:
        keyed = lines.withColumn("at", F.monotonically_increasing_id()).join(state, ["file", "start"])
        placed = keyed.repartition("file", "start").sortWithinPartitions("file", "start", "at").drop("at")
    parsed = _parsed(placed.select("value", "file", "start", "inside"))
    split = written(parsed.where("kind is not null").select("first", "file", "start", "kind", "text"))
    return parsed.where("kind is null").select("fields", "first").unionByName(_whole(split))
