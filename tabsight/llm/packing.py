"""Best-fit packing by length-histogram planning.

Documents are tokenised where they lie and cut only if longer than a sequence.
The plan is made from the histogram of piece lengths alone: for each length from
the longest down, all pieces of that length go, as counts, into the open
sequences with the least room that fits. The histogram has at most ``capacity``
rows and the plan at most ``capacity**2``, whatever the number of documents.
Pieces then take the planned slots by their rank within their length."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, rank_within, row_key, written

#: Letters, digits, marks and spaces on which both tokenizer libraries split
#: alike; other texts go the slower way.
PLAIN = r"[\x00-ɏ‐-‧‰-⁞€]*"


class Encoder:
    """Ids of whole texts by the vocabulary file ``path`` (tokenizers), without
    special tokens added.

    Two ways lead to the same ids: texts of plain Latin characters may go through
    the same vocabulary as ranks (tiktoken), which is several times faster; texts
    with other characters or a special token's string go through ``tokenizers``."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import os
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.plain = re.compile(PLAIN)
            self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if self.fast and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, after a
    shorter first piece if ``n`` is no multiple."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n > capacity else [(0, n)]


def pieces(df: DataFrame, encoder, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of ``df`` (doc_id, text): doc_id, content
    key, piece, start, length, ids_crc32 and, if ``keep_ids``, the ids as
    little-endian unsigned 32-bit. ``encoder()`` makes an :class:`Encoder` in a task."""
    prepare(df)
    base = df.select("doc_id", *row_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    added = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()} \
        | ({"ids": T.BinaryType()} if keep_ids else {})

    def run(batches):
        import zlib

        import numpy as np
        encode = encoder()
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[s:s + n].tobytes()
                    rows.append(i)
                    out.append((k, s, n, zlib.crc32(raw), raw))
            yield b, rows, dict(zip(added, zip(*out, strict=True) if out else [[]] * len(added)))

    return map_arrow(base, ["doc_id", "__h1", "__h2"], added, run)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, from_rank, n, first_bin,
    per_bin, offset): ranks from_rank .. from_rank+n-1 of the length take bins
    first_bin, first_bin+1, .., ``per_bin`` pieces each, from ``offset`` on."""
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first bin, bins)
    rooms: list[int] = []  # sorted rooms in use
    rows, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            per = room // length
            whole = min(n, left // per)
            if whole:
                rows.append((length, rank, whole * per, first, per, capacity - room))
                put(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if left and whole < n:  # fewer pieces than one bin would take
                rows.append((length, rank, left, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, n - whole if room < capacity else 0)
    return rows


def pack(df: DataFrame, encoder, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The rows of :func:`pieces` with sequence_id and offset: the place of each
    piece in sequences of at most ``capacity`` ids, filled from 0 without gaps.

    A null text is empty, and an empty text is one piece of the end id alone.
    Null ids and repeated rows are packed like any other row; an empty table
    gives an empty result; other columns are not read."""
    spark = prepare(df)
    made = written(pieces(df, encoder, capacity, end_id, keep_ids))
    counts = {int(r[0]): r[1] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    ranked = rank_within(made, "length", [F.col("__h1"), F.col("__h2"), F.col("doc_id"), F.col("piece")])
    slots = spark.sparkContext.broadcast(rows)  # at most capacity**2 rows

    def take(batches):
        import numpy as np
        table = np.array(slots.value, dtype="int64").reshape(-1, 6)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        step = int((table[:, 1] + table[:, 2]).max()) + 1 if len(table) else 1
        where = table[:, 0] * step + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(where, length * step + rank, side="right") - 1]
            t = rank - row[:, 1]
            yield b, None, {"sequence_id": row[:, 3] + t // row[:, 4], "offset": row[:, 5] + t % row[:, 4] * length}

    return map_arrow(ranked, made.columns, {"sequence_id": T.LongType(), "offset": T.LongType()}, take)
