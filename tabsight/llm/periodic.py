"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch of words with smallest period q whose length is at least
four periods (and ``min_length`` words). Let b be the least power of two that is not
below q. Then some dyadic block [x, x + b) with b | x lies inside the run, and the run
holds the block's next occurrence at x + q or its last one at x - q: the aligned starts
inside the run lie in an interval of at least b places, and the run is too long to miss
both neighbours. As b >= q, nothing of the run matches the block at a smaller distance,
so the occurrences around x form an arithmetic progression of difference q.

So for each level b and each block, two queries give all candidates: the occurrence
that follows x and the one that precedes it, within b words. Occurrences of a block are
a range of the suffix array, and both are found there by a wavelet matrix: the rank of
x in the range, then the values of the ranks above and below it. Suffix ranges of the
blocks fall out of the suffix array's construction by prefix doubling. Neighbouring
blocks that name the same period are merged, and their ends extended to the run.

A task takes texts in batches of about ``BATCH_WORDS`` words; a longer text is a batch
of its own. Words are told apart by text, so nothing matches across texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, row_key

#: Words of a batch.
BATCH_WORDS = 120_000
#: Periods that a run holds at least; the search relies on four.
MIN_EXPONENT = 4


def suffix_ranges(codes):
    """Suffix array of ``codes`` (int64, the last one unique) and, for each level
    k, the (starts, lo, hi) of the blocks of 2**k codes at multiples of 2**k that
    occur at least twice: the block's occurrences are ``array[lo:hi]``.

    Prefix doubling: after level k a suffix's rank is the first place of the
    suffixes that share its first 2**k codes. Only places whose rank is still
    shared are sorted again."""
    import numpy as np
    n = len(codes)
    array = np.argsort(codes, kind="stable")
    sorted_codes = codes[array]
    first = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
    sizes = np.diff(np.r_[first, n])
    rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[array], size[array] = np.repeat(first, sizes), np.repeat(sizes, sizes)
    open_at = np.flatnonzero(size[array] > 1)  # places of the suffix array
    levels, h = [], 1
    while True:
        starts = np.arange(0, n, h)
        starts = starts[size[starts] > 1]
        levels.append((starts, rank[starts], rank[starts] + size[starts]))
        if not len(open_at):
            return array, levels
        who = array[open_at]
        key = rank[who] * (n + 1) + rank[who + h]  # a shared prefix of h codes ends before the last, unique one
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        array[open_at] = who  # places of a rank are consecutive, so sorting keeps groups in place
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        rank[who], size[who] = np.repeat(open_at[first], sizes), np.repeat(sizes, sizes)
        open_at = open_at[np.repeat(sizes, sizes) > 1]
        h *= 2


class WaveletMatrix:
    """Rank and selection over ranges of an array of integers below 2**bits: one bit
    of each value a level, highest first, values with a 0 before those with a 1."""

    def __init__(self, values):
        import numpy as np
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.before = [], []
        v = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            zero = (v >> level & 1) == 0
            before = np.zeros(len(v) + 1, np.int32)  # zeros among the first i values
            np.cumsum(zero, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            v = np.concatenate((v[zero], v[~zero]))

    def smaller(self, lo, hi, x):
        """How many of the values at [lo, hi) are below x, for arrays of queries."""
        import numpy as np
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, before, zeros in zip(range(self.bits - 1, -1, -1), self.before, self.zeros, strict=True):
            zlo, zhi = before[lo], before[hi]
            one = (x >> level & 1) == 1
            out += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, zeros + lo - zlo, zlo), np.where(one, zeros + hi - zhi, zhi)
        return out

    def nth(self, lo, hi, k):
        """The k-th smallest (from 0) of the values at [lo, hi), for arrays of queries."""
        import numpy as np
        lo, hi, k, out = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for level, before, zeros in zip(range(self.bits - 1, -1, -1), self.before, self.zeros, strict=True):
            zlo, zhi = before[lo], before[hi]
            one = k >= zhi - zlo
            out |= one.astype(np.int64) << level
            k = np.where(one, k - (zhi - zlo), k)
            lo, hi = np.where(one, zeros + lo - zlo, zlo), np.where(one, zeros + hi - zhi, zhi)
        return out


def progressions(codes, min_length: int):
    """(x, b, d) arrays: blocks of b codes at x that occur again at x + d or x - d, d
    in (b/2, b], with nothing nearer on that side."""
    import numpy as np
    array, levels = suffix_ranges(codes)
    tree = WaveletMatrix(array)
    found = []
    for k, (x, lo, hi) in enumerate(levels):
        b = 1 << k
        if b == 1:  # a run of one repeated word holds it min_length times
            often = hi - lo >= min_length
            x, lo, hi = x[often], lo[often], hi[often]
        if not len(x):
            continue
        at = tree.smaller(lo, hi, x)
        for side in (1, -1):
            ok = np.flatnonzero((at + side >= 0) & (at + side < hi - lo))
            d = (tree.nth(lo[ok], hi[ok], at[ok] + side) - x[ok]) * side
            near = (d <= b) & (2 * d > b)
            found.append(np.stack((x[ok][near], np.full(int(near.sum()), b), d[near])))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def _same_back(codes, i: int, d: int, least: int) -> int:
    """The least j >= ``least`` such that codes[j:i] equals codes[j + d:i + d]."""
    import numpy as np
    step = 32
    while i > least:
        j = max(least, i - step)
        other = np.flatnonzero(codes[j:i] != codes[j + d:i + d])
        if len(other):
            return j + int(other[-1]) + 1
        i, step = j, 2 * step
    return i


def _same_on(codes, i: int, d: int, most: int) -> int:
    """The largest j <= ``most`` such that codes[i:j] equals codes[i - d:j - d]."""
    import numpy as np
    step = 32
    while i < most:
        j = min(most, i + step)
        other = np.flatnonzero(codes[i:j] != codes[i - d:j - d])
        if len(other):
            return i + int(other[0])
        i, step = j, 2 * step
    return i


def runs(codes, bounds, min_length: int = 6):
    """Sorted distinct (start, length, period) of all runs in the concatenated texts
    ``codes``; text t covers bounds[t] to bounds[t + 1] - 1, where a unique code ends it."""
    import numpy as np
    x, b, d = progressions(codes, min_length)
    order = np.lexsort((x, d, b))
    x, b, d = x[order], b[order], d[order]
    out = set()
    if not len(x):
        return []
    # neighbouring blocks of one level and period: one stretch, if the words in it agree
    new = np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1]) | (x[1:] > x[:-1] + b[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(x)] - 1
    text = np.searchsorted(bounds, x[first], side="right") - 1
    for i, j, t in zip(first.tolist(), last.tolist(), text.tolist(), strict=True):
        period, low, end = int(d[i]), int(bounds[t]), int(bounds[t + 1]) - 1
        starts = [int(x[i])]
        if _same_on(codes, starts[0] + period, period, end) < x[j] + b[j]:
            starts = x[i:j + 1].tolist()
        for at in starts:
            stop = _same_on(codes, at + period, period, end)
            start = _same_back(codes, at, period, low)
            if stop - start >= max(min_length, MIN_EXPONENT * period):
                out.add((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def batch_runs(texts, min_length: int = 6):
    """For each of ``texts`` its words and the (start, length, period) of its runs,
    by start, then period."""
    import numpy as np
    import pandas as pd
    # bytes.split() splits at \t..\r and space: the words of WORD_PATTERN
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    bounds = np.r_[0, np.cumsum(counts + 1)]
    total = int(counts.sum())
    found = [[] for _ in texts]
    if not total:
        return words, found
    flat = np.empty(total, object)
    flat[:] = [w for some in words for w in some]
    code, known = pd.factorize(flat)
    code = code + np.repeat(np.arange(len(texts)), counts) * len(known)
    full = np.empty(total + len(texts), np.int64)
    ends = bounds[1:] - 1
    inside = np.ones(len(full), bool)
    inside[ends] = False
    full[inside] = code
    full[ends] = len(texts) * len(known) + np.arange(len(texts))
    for s, n, q in runs(full, bounds, min_length):
        t = int(np.searchsorted(bounds, s, side="right")) - 1
        found[t].append((s - int(bounds[t]), n, q))
    return words, found


def collapsed(words, found) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    import numpy as np
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, min_length: int = 6) -> DataFrame:
    """(doc_id, content key, n_words, runs, collapsed) for each row of ``df`` (doc_id,
    text): ``runs`` is the array of (start, length, period) of all runs of at least
    ``min_length`` words and four periods, by start, then period; ``collapsed`` is the
    text's words without those that repeat a run's first period.

    A null, empty or wordless text has no runs and is empty when collapsed. Null ids and
    repeated rows are rows like any other; an empty table gives an empty result; other
    columns are not read. A text is worked on in one task, with about 300 bytes a word."""
    prepare(df)
    base = df.select("doc_id", *row_key(F.col("text")), "text")
    run = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])

    def go(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, room = at, 6 * BATCH_WORDS  # a word takes about six characters
                while end < len(texts) and (end == at or room > 0):
                    room -= len(texts[end] or "") + 6
                    end += 1
                words, found = batch_runs(texts[at:end], min_length)
                yield b, list(range(at, end)), {
                    "n_words": [len(w) for w in words],
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found],
                    "collapsed": [collapsed(w, f).decode("utf-8", "surrogatepass") for w, f in zip(words, found, strict=True)]}
                at = end

    return map_arrow(base, ["doc_id", "__h1", "__h2"],
                     {"n_words": T.LongType(), "runs": T.ArrayType(run, False), "collapsed": T.StringType()}, go)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) of the rows of :func:`periodic_runs`. The four name the run with
    the greatest length / period (ties: least start, then period); without runs they are
    null. runs_sha256 digests a line ``start,length,period`` for each run."""
    def better(a, b):  # exact: fractions compared by cross multiplication; runs come by start, then period
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
