"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The
prefixes of a conversation are rendered one after the other; what the next
output adds to the last one is the next turn's span. If the next output does not
begin with the last one, the template rewrites history at that turn, and the row
says so instead of giving a span that is not there.

Turns are dealt out by conversation and sorted, and each task streams over its
rows: it holds the turns of the current base. With a declared look-back these are
twice as many turns as that, without one the conversation so far."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, shuffle_partitions

Template = Callable[[list[tuple[str, str]]], str]

#: The control strings of the default template.
HEAD, TAIL = "### ", "</turn>"


def escape(text: str) -> str:
    """Put a backslash before backslashes and before the control strings."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(TAIL, "\\" + TAIL)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def escape_role(role: str) -> str:
    """Roles also hide the colon that ends them."""
    return escape(role).replace(":", "\\:")


#: How far the default template looks back: it writes each turn by itself.
MARKED_LOOK_BACK = 1


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The default template: ``### role: text</turn>`` and a line end for each turn."""
    return "".join(f"{HEAD}{escape_role(r)}: {escape(t)}{TAIL}\n" for r, t in turns)


_PARSED = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)


def parse_turn(segment: str) -> tuple[str, str, int, int]:
    """(role, text, content start, content end) of one turn's span of the default
    template; the reverse of :func:`marked_turns`."""
    m = _PARSED.fullmatch(segment)
    if not m:
        raise ValueError("not a span of the default template")
    role = re.sub(r"\\(\\|###|</turn>|:)", r"\1", m[1])
    return role, unescape(m[2]), m.start(2), m.end(2)


def turn_spans(turns: Iterator[tuple[str, str]], template: Template, window: int | None = None):
    """(segment, rewrites) for each turn. Every prefix is rendered from the first
    turn, at a quadratic cost, unless the caller declares how far the template
    looks back: with ``window`` = k the base moves on by k turns and holds up to
    2k, so that any turn but the first k is rendered after k earlier ones at least.
    A template that numbers turns, reads the system turn or asks for a certain
    role at the start looks back to the first turn and must have None."""
    base: list[tuple[str, str]] = []
    before = ""
    for turn in turns:
        if window and len(base) >= 2 * window:
            base = base[-window:]
            before = template(base)
        base.append(turn)
        now = template(base)
        rewrites = not now.startswith(before)
        yield ("" if rewrites else now[len(before):]), rewrites
        before = now


def format_turns(df: DataFrame, template: Template = marked_turns, loss_role: str = "assistant",
                 window: int | None = None) -> DataFrame:
    """One row for each turn of ``df`` (conv_id, turn, role, text), in order within
    its conversation and partition: conv_id, turn, place, segment (the span's
    text), span_start and span_end in the formatted conversation (code points),
    loss (whether the segment's turn is under the loss mask), rewrites.

    A null text or role is an empty string. Rows of one conversation are ordered
    by turn, nulls first, then role and text; repeated rows are turns of their
    own. Rows with a null conv_id are one conversation. An empty table gives an
    empty result; other columns are not read. The conversation's formatted text
    is the segments in order; where ``rewrites`` is set it has no such form.
    ``window`` is the template's look-back as in :func:`turn_spans`."""
    spark = prepare(df)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    marked = dealt.withColumn("__key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))

    def run(batches):
        key, feed, out = None, None, None
        place = at = 0
        for b in batches:
            made = []
            for k, role, text in zip(*[b.column(c).to_pylist() for c in ("__key", "role", "text")], strict=True):
                if k != key:
                    key, place, at = k, 0, 0
                    feed = []
                    out = turn_spans(_drain(feed), template, window)
                feed.append((role, text))
                segment, rewrites = next(out)
                made.append((place, segment, at, at + len(segment), role == loss_role, rewrites))
                place, at = place + 1, at + len(segment)
            yield b, None, dict(zip(added, zip(*made, strict=True) if made else [[]] * len(added), strict=True))

    added = {"place": T.LongType(), "segment": T.StringType(), "span_start": T.LongType(),
             "span_end": T.LongType(), "loss": T.BooleanType(), "rewrites": T.BooleanType()}
    return map_arrow(marked, ["conv_id", "turn", "__key"], added, run)


def _drain(feed: list):
    """Yields what is appended to ``feed``, one at a time."""
    while True:
        yield feed.pop(0)


def digests(turn_rows: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations of the default template:
    one row for each conversation. ``turn_rows`` must be as :func:`format_turns`
    gives it; each task streams over its rows and keeps running digests only."""

    def run(batches):
        import pyarrow as pa
        key, state, held = None, None, None

        def emit(rows):
            ids = pa.RecordBatch.from_arrays([pa.concat_arrays([r[0] for r in rows])], names=["conv_id"])
            return ids, None, {n: [r[k + 1] for r in rows] for k, n in enumerate(added)}

        def row():
            n, turns, chars, loss, total = state
            return (held, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            made = []
            for i, (k, segment, under) in enumerate(zip(*[b.column(c).to_pylist() for c in ("__key", "segment", "loss")], strict=True)):
                if state is None or k != key:
                    if state:
                        made.append(row())
                    key, state, held = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], b.column("conv_id").slice(i, 1)
                role, text, _, _ = parse_turn(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if under:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if made:
                yield emit(made)
        if state:
            yield emit([row()])

    added = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(),
             "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    return map_arrow(turn_rows, ["conv_id"], added, run)
