"""Alignment of two tokenizers' output on the same text, by divide and conquer.

Both token sequences cover the same bytes. An interval of them is split at a common end
near its middle: the middle byte is looked up among A's ends (in a table of all bytes of a
batch), and each of A's ends from there outwards is looked up among B's ends. The nearest one that both have
splits the interval, and both halves are split in the same way. An interval without a
common end inside is a leaf group. All intervals of a batch of texts are split together,
level by level, so a level is a handful of array operations.

An A and a B token are linked where their bytes overlap, and a pair of ids counts the
documents that hold it linked. Counts are summed per task before they are shuffled. The
finished table of pairs goes back to the documents in blocks of bounded size, one
broadcast after the other, so it may grow beyond any one broadcast."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_byte_limit
from .common import map_arrow, prepare, row_key, scratch_folder, written

#: Characters of text that a task encodes and aligns at a time.
BATCH_CHARS = 1_000_000
#: Distinct (text, pair) rows that a task sums up at a time.
PAIR_ROWS = 4_000_000
#: Bytes of a row of the broadcast table: pair, count, flag.
PAIR_BYTES = 17


@dataclass
class Tokenizer:
    """``encode`` gives the id lists of texts; ``token_bytes`` the bytes of each id."""
    encode: Callable[[list[str]], list[list[int]]]
    token_bytes: list[bytes]


def byte_level(path: str, ranks: str | None = None, pattern: str | None = None, lead: str = " ") -> Tokenizer:
    """A byte-level BPE file; ``lead`` is put before each text. Special tokens' strings
    are plain text. ``ranks`` and ``pattern`` name the same vocabulary as ranks, which is
    faster on plain Latin texts (see :class:`packing.Encoder`)."""
    from .packing import Encoder
    encoder = Encoder(path, ranks, pattern)
    encoder.slow.encode_special_tokens = True
    encoder.special = []
    # The byte-level alphabet. Printable Latin-1 bytes stand for themselves,
    # the others for the characters from U+0100 on, in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    size = encoder.slow.get_vocab_size()
    table = [b""] * size
    for token, i in encoder.slow.get_vocab().items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return Tokenizer(lambda texts: [encoder(lead + t) for t in texts], table)


def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, which puts a space before each text itself."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), table)


def _counter(s, top: int):
    """(below, upto): how many of the ascending byte places ``s`` are below, or at most, given
    ones from 0 to ``top``; read from a table of all places, or searched where places repeat."""
    import numpy as np
    if not (s[1:] > s[:-1]).all():
        return (lambda v: np.searchsorted(s, v)), (lambda v: np.searchsorted(s, v, side="right"))
    table = np.zeros(top + 2, np.int32)
    table[s + 1] = 1
    np.cumsum(table, out=table)
    return (lambda v: table[v]), (lambda v: table[v + 1])


def _overlaps(sa, sb):
    """For each token of A the first token of B that overlaps its bytes, and how many do."""
    import numpy as np
    below, upto = _counter(sb, int(max(sa[-1], sb[-1])))
    first = upto(sa[:-1]).astype(np.int64) - 1  # less the 0 at the start
    return first, np.minimum(below(sa[1:]), len(sb) - 1) - first


def _nearest_cut(sa, sb, low: int, high: int, middle: int) -> int:
    """The c in (low, high) nearest to ``middle`` such that sa[c] is in sb, or -1."""
    import numpy as np
    width = 16
    while True:
        lo, hi = max(low + 1, middle - width), min(high, middle + width + 1)
        at = np.arange(lo, hi)
        hits = at[sb[np.searchsorted(sb, sa[at])] == sa[at]]
        if len(hits):
            return int(hits[np.argmin(np.abs(hits - middle))])
        if lo == low + 1 and hi == high:
            return -1
        width *= 4


def leaf_groups(sa, sb, bounds_a, bounds_b):
    """(ends_a, ends_b): for each leaf group in order, the numbers of A's and B's tokens
    up to its end. sa and sb hold 0 and the tokens' end bytes in the concatenated texts;
    text t has tokens bounds_a[t] to bounds_a[t + 1] of A, and likewise of B."""
    import numpy as np
    al, ah, bl, bh = bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]
    some = ah > al
    al, ah, bl, bh = al[some], ah[some], bl[some], bh[some]
    done_a, done_b = [], []
    top = int(max(sa[-1], sb[-1]))
    below_a = _counter(sa, top)[0]
    place_b = np.minimum(_counter(sb, top)[0](sa), len(sb) - 1)  # of each of A's ends among B's
    shared = sb[place_b] == sa
    so_far = np.r_[0, np.cumsum(shared)]
    while len(al):
        leaf = (ah - al < 2) | (bh - bl < 2)
        leaf |= so_far[ah] <= so_far[np.minimum(al + 1, ah)]  # no common end inside
        done_a.append(ah[leaf])
        done_b.append(bh[leaf])
        al, ah, bl, bh = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf]
        middle = np.clip(below_a((sa[al] + sa[ah]) // 2), al + 1, ah - 1)
        cut_a, cut_b = np.full(len(al), -1), np.zeros(len(al), np.int64)
        left = np.arange(len(al))
        for step in (0, 1, -1, 2, -2, 3, -3, 4, -4):  # most intervals have a cut this near
            c = middle[left] + step
            ok = (c > al[left]) & (c < ah[left])
            c, who = c[ok], left[ok]
            hit = shared[c]
            cut_a[who[hit]], cut_b[who[hit]] = c[hit], place_b[c[hit]]
            left = left[cut_a[left] < 0]
        left = left[(middle[left] - 4 > al[left] + 1) | (middle[left] + 5 < ah[left])]  # others have none
        for i in left.tolist():
            c = _nearest_cut(sa, sb, int(al[i]), int(ah[i]), int(middle[i]))
            if c >= 0:
                cut_a[i], cut_b[i] = c, np.searchsorted(sb, sa[c])
        none = cut_a < 0
        done_a.append(ah[none])
        done_b.append(bh[none])
        al, ah, bl, bh, ca, cb = (v[~none] for v in (al, ah, bl, bh, cut_a, cut_b))
        al, ah, bl, bh = (np.stack(ends, axis=1).ravel() for ends in ((al, ca), (ca, ah), (bl, cb), (cb, bh)))
    if not done_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends_a, ends_b = np.concatenate(done_a), np.concatenate(done_b)
    order = np.argsort(ends_a)
    return ends_a[order], ends_b[order]


def links(sa, sb):
    """(i, j) of all tokens of A and B whose bytes overlap, by i, then j."""
    import numpy as np
    first, n = _overlaps(sa, sb)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)


def _ends(lengths):
    import numpy as np
    return np.r_[0, np.cumsum(lengths)].astype(np.int64)


def _id_type(tokenizer_size: int) -> str:
    return "<u2" if tokenizer_size <= 1 << 16 else "<u4"


class Aligner:
    """Encodes and aligns batches of texts with the tokenizers A and B."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        import numpy as np
        self.a, self.b = a, b
        self.len_a, self.len_b = (np.array([len(x) for x in t.token_bytes], np.int64) for t in (a, b))
        self.type_a, self.type_b = _id_type(len(self.len_a)), _id_type(len(self.len_b))

        def marked(size, mark):
            return np.array([b"%d%s" % (i, mark) for i in range(size)], object)
        self.inner_a, self.last_a = (marked(len(self.len_a), m) for m in (b",", b"|"))
        self.inner_b, self.last_b = (marked(len(self.len_b), m) for m in (b",", b";"))

    def encode(self, texts: list[str | None], lead: str = " "):
        """(ids of A, ids of B) for each text: empty where the text is, or where either
        tokenizer's bytes aren't ``lead`` and the text."""
        filled = [t or "" for t in texts]
        out = []
        for text, a, b in zip(filled, self.a.encode(filled), self.b.encode(filled), strict=True):
            want = (lead + text).encode("utf-8", "surrogatepass")
            same = text and b"".join(map(self.a.token_bytes.__getitem__, a)) == want \
                and b"".join(map(self.b.token_bytes.__getitem__, b)) == want
            out.append((a, b) if same else ((), ()))
        return out

    def align(self, texts: list[str | None]):
        """Of each text: ids of A and B, group ends in A and B, number of links, and the
        groups written as ``a1,a2|b1;a3|b2,b3``."""
        import numpy as np
        both = self.encode(texts)
        ids_a, ids_b = (np.concatenate([np.array(pair[side], np.int64) for pair in both]) for side in (0, 1))
        bounds_a, bounds_b = (_ends([len(pair[side]) for pair in both]) for side in (0, 1))
        sa, sb = _ends(self.len_a[ids_a]), _ends(self.len_b[ids_b])
        ends_a, ends_b = leaf_groups(sa, sb, bounds_a, bounds_b)
        linked = np.zeros(len(sa), np.int64)
        linked[1:] = np.cumsum(_overlaps(sa, sb)[1])
        # the tokens in writing order: of each group first A's, then B's
        sizes_a, sizes_b = np.diff(np.r_[0, ends_a]), np.diff(np.r_[0, ends_b])
        words = np.empty(len(ids_a) + len(ids_b), object)
        at_a = np.arange(len(ids_a)) + np.repeat(ends_b - sizes_b, sizes_a)
        at_b = np.arange(len(ids_b)) + np.repeat(ends_a, sizes_b)
        words[at_a], words[at_b] = self.inner_a[ids_a], self.inner_b[ids_b]
        if len(ends_a):
            words[at_a[ends_a - 1]], words[at_b[ends_b - 1]] = self.last_a[ids_a[ends_a - 1]], self.last_b[ids_b[ends_b - 1]]
        cuts = np.searchsorted(ends_a, bounds_a, side="right")
        for t in range(len(texts)):
            a, b, g = slice(*bounds_a[t:t + 2]), slice(*bounds_b[t:t + 2]), slice(*cuts[t:t + 2])
            yield (ids_a[a], ids_b[b], ends_a[g] - bounds_a[t], ends_b[g] - bounds_b[t],
                   int(linked[bounds_a[t + 1]] - linked[bounds_a[t]]),
                   b"".join(words[bounds_a[t] + bounds_b[t]:bounds_a[t + 1] + bounds_b[t + 1]].tolist())[:-1])


def _slices(column, most: int):
    """(start, end, texts) of runs of rows with about ``most`` characters."""
    texts = column.to_pylist()
    at = 0
    while at < len(texts):
        end, room = at, most
        while end < len(texts) and (end == at or room > 0):
            room -= len(texts[end] or "")
            end += 1
        yield at, end, texts[at:end]
        at = end


def alignments(df: DataFrame, tokenizers) -> DataFrame:
    """(doc_id, content key, a_ids, b_ids, a_ends, b_ends, n_links, groups_sha256) for each
    row of ``df`` (doc_id, text). ``tokenizers()`` makes the two :class:`Tokenizer` in a task.

    Ids are little-endian, two bytes where the vocabulary allows, else four; a_ends and
    b_ends hold for each leaf group the number of tokens up to its end, as 32-bit integers.
    groups_sha256 digests the groups' text. A null or empty text, and one whose bytes a
    tokenizer changes, has no tokens and an empty digest. Repeated rows and null ids are rows
    like any other; an empty table gives an empty result; other columns are not read."""
    prepare(df)
    base = df.select("doc_id", *row_key(F.col("text")), "text")

    def run(batches):
        import hashlib
        aligner = Aligner(*tokenizers())
        for b in batches:
            for start, end, texts in _slices(b.column("text"), BATCH_CHARS):
                rows = list(aligner.align(texts))
                yield b, range(start, end), {
                    "a_ids": [r[0].astype(aligner.type_a).tobytes() for r in rows],
                    "b_ids": [r[1].astype(aligner.type_b).tobytes() for r in rows],
                    "a_ends": [r[2].astype("<i4").tobytes() for r in rows], "b_ends": [r[3].astype("<i4").tobytes() for r in rows],
                    "n_groups": [len(r[2]) for r in rows], "n_links": [r[4] for r in rows],
                    "groups_sha256": [hashlib.sha256(r[5]).hexdigest() if len(r[0]) else "" for r in rows]}

    return map_arrow(base, ["doc_id", "__h1", "__h2"], {
        "a_ids": T.BinaryType(), "b_ids": T.BinaryType(), "a_ends": T.BinaryType(), "b_ends": T.BinaryType(),
        "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}, run)


def _linked_pairs(batch, tables):
    """(row, pair) of all links of a batch's rows: row is the place in the batch, pair
    the id of A times the size of B's vocabulary plus the id of B."""
    import numpy as np
    len_a, len_b, type_a, type_b = tables
    raw_a, raw_b = batch.column("a_ids").to_pylist(), batch.column("b_ids").to_pylist()
    ids_a = np.frombuffer(b"".join(raw_a), type_a).astype(np.int64)
    ids_b = np.frombuffer(b"".join(raw_b), type_b).astype(np.int64)
    i, j = links(_ends(len_a[ids_a]), _ends(len_b[ids_b]))
    row = np.repeat(np.arange(len(raw_a)), [len(r) // np.dtype(type_a).itemsize for r in raw_a])
    return row[i], ids_a[i] * len(len_b) + ids_b[j]


def _tables(tokenizers):
    aligner = Aligner(*tokenizers())
    return aligner.len_a, aligner.len_b, aligner.type_a, aligner.type_b


def _short(batch, rows: int = 500):
    """A batch in slices, so that the arrays over their links stay small."""
    return (batch.slice(s, rows) for s in range(0, batch.num_rows, rows))


def pair_counts(aligned: DataFrame, tokenizers) -> DataFrame:
    """(pair, docs, best): in how many rows of ``aligned`` a pair of ids is linked, and
    whether no other pair of the same id of A has more."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        tables = _tables(tokenizers)
        size = len(tables[0]) * len(tables[1])
        pairs, docs, held = np.empty(0, np.int64), np.empty(0, np.int64), []

        def summed():
            one = np.concatenate([pairs, *held])
            count = np.concatenate([docs, np.ones(len(one) - len(pairs), np.int64)])
            order = np.argsort(one, kind="stable")
            one, count = one[order], count[order]
            first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
            return one[first], np.add.reduceat(count, first)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])

        for b in batches:
            for part in _short(b):
                row, pair = _linked_pairs(part, tables)
                held.append(np.unique(row * size + pair) % size)
                if sum(map(len, held)) > PAIR_ROWS:
                    pairs, docs = summed()
                    held = []
                    if len(pairs) > PAIR_ROWS:
                        yield rows()
                        pairs, docs = pairs[:0], docs[:0]
        if held:
            pairs, docs = summed() if sum(map(len, held)) + len(pairs) else (pairs, docs)
        yield rows()

    prepare(aligned)
    size_b = len(tokenizers()[1].token_bytes)
    counts = written(aligned.select("a_ids", "b_ids").mapInArrow(run, "pair long, docs long")
                     .groupBy("pair").agg(F.sum("docs").alias("docs")))
    a = F.expr(f"pair div {size_b}")
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top"))
    return counts.join(top, a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def _scored(aligned: DataFrame, block, n_blocks: int, which: int, tokenizers) -> DataFrame:
    """``aligned`` with the links of the pairs of one block added to n_best and count_sum."""
    carry = [c for c in aligned.columns if c not in ("n_best", "count_sum")]

    def run(batches):
        import numpy as np
        tables = _tables(tokenizers)
        pairs, docs, best = block.value
        for b in batches:
            for part in _short(b):
                row, pair = _linked_pairs(part, tables)
                if n_blocks > 1:
                    mine = pair % n_blocks == which
                    row, pair = row[mine], pair[mine]
                known, back = np.unique(pair, return_inverse=True)
                at = np.searchsorted(pairs, known)
                n_best, total = (part.column(c).to_numpy().copy() for c in ("n_best", "count_sum"))
                n_best += np.bincount(row, weights=best[at][back], minlength=part.num_rows).astype(np.int64)
                sums = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, row, docs[at][back])
                yield part, None, {"n_best": n_best, "count_sum": total + sums}

    return map_arrow(aligned, carry, {"n_best": T.LongType(), "count_sum": T.LongType()}, run)


def link_scores(aligned: DataFrame, tokenizers) -> DataFrame:
    """``aligned`` (a written table of :func:`alignments`) plus n_best and count_sum: how
    many links of a row are of their A id's most frequent pair (ties included), and the sum
    of the links' counts. The table of counts is dealt into blocks that each stay below the
    session's broadcast limit; each block takes one pass over ``aligned``."""
    import numpy as np
    spark = prepare(aligned)
    counts = written(pair_counts(aligned, tokenizers))
    most = max(1, broadcast_byte_limit(spark) // PAIR_BYTES)
    n_blocks = max(1, -(-counts.count() // most))
    while n_blocks > 1 and counts.groupBy(F.col("pair") % n_blocks).count().agg(F.max("count")).first()[0] > most:
        n_blocks += 1 + n_blocks // 4
    scored = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for which in range(n_blocks):
        rows = counts.filter(F.col("pair") % n_blocks == which).toArrow()  # at most ``most`` rows
        pair, docs, best = (rows.column(c).to_numpy() for c in ("pair", "docs", "best"))
        order = np.argsort(pair)
        block = spark.sparkContext.broadcast((pair[order], docs[order], best[order].astype(np.float64)))
        scored = _scored(scored, block, n_blocks, which, tokenizers)
        if which < n_blocks - 1:
            scored = written(scored)
            block.destroy()
    return scored


def aligned_digests(df: DataFrame, tokenizers) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row
    of ``df``, with the cases that :func:`alignments` defines; texts without tokens are zeros."""
    found = alignments(df, tokenizers).drop("a_ends", "b_ends")
    path = scratch_folder(df.sparkSession)
    found.write.option("compression", "zstd").parquet(path)  # ids are most of it
    aligned = df.sparkSession.read.schema(found.schema).parquet(path)
    size_a, size_b = (2 if len(t.token_bytes) <= 1 << 16 else 4 for t in tokenizers())
    return link_scores(aligned, tokenizers).select(
        "doc_id", F.expr(f"octet_length(a_ids) div {size_a}").alias("n_a"), F.expr(f"octet_length(b_ids) div {size_b}").alias("n_b"),
        "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
