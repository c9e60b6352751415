"""Near-duplicate groups by MinHash with tensored banding.

A document's set holds its distinct word shingles. Instead of one band of
``2 * width`` minhashes for each of ``half * half`` tables, two collections of
``half`` short bands are computed, A and B; table (i, j) is keyed by the pair of
A's i-th and B's j-th band. So ``half**2`` tables cost ``2 * half * width``
minhashes. Two documents of similarity s meet in a table with probability
(1 - (1 - s**width)**half)**2: with the defaults 0.99992 at s = 0.8.

Equal sets are one class from the start. In the table (0, 0) each
bucket's classes are compared with its first one, on their full sets, and connected
classes are joined; then so are those of the other tables (i, i) that are still apart, and,
while that joins many, those of the tables (i, i + 1), (i, i + 2) and so on, each bucket's
classes compared with another first one. Then, in all tables, every pair of classes of different components that shares a bucket is
settled: by exact bounds where these are enough, else on full sets. The bounds:
what two classes of different components have in common lies among the shingles
that occur in more than one component, so a class with too few of these is out at
once, and a pair by the smaller of its two counts; and a bit that a shingle sets in
one class's bitmap but none in the other's is a shingle they do not share. A pair
is looked at in its first common table only. Buckets are sorted and range
partitioned, so a bucket of any size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, map_arrow, prepare, row_key, shuffle_partitions, written

M64 = (1 << 64) - 1
#: Longs of a class's bitmap.
BITMAP = 8
#: Rounds of stars end when fewer than one in so many compared pairs is linked.
FEW = 50


def _mix(x):
    """A 64-bit finaliser, element by element: xor-shifts and odd multipliers."""
    import numpy as np
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of a whole text's word shingles. A text with
    fewer words is one shingle; without words the set is empty."""
    import numpy as np
    import xxhash
    if not text:
        return np.empty(0, dtype=np.uint64)
    # bytes.split() splits at \t..\r and space, bytes.lower() lowers A-Z: the contract's words
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = _mix(out) + h[k:k + n]
    out = _mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def _seeds(count: int, seed: int):
    import numpy as np
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, M64, count, dtype=np.uint64) | np.uint64(1), rng.integers(1, M64, count, dtype=np.uint64)


def bands(sets, half: int, width: int, seed: int = 3):
    """(n, 2 * half) uint64: the bands of collections A and B for each of ``sets``
    (none empty). A minhash is the least (mul * x + add) mod 2**64 over the set."""
    import numpy as np
    mul, add = _seeds(2 * half * width, seed)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    x = np.concatenate(sets)
    mins = np.stack([np.minimum.reduceat(x * m + a, starts) for m, a in zip(mul, add, strict=True)], axis=1)
    mins = mins.reshape(len(sets), 2 * half, width)
    out = np.zeros((len(sets), 2 * half), dtype=np.uint64)
    for k in range(width):
        out = _mix(out + mins[:, :, k])
    return out


def table_keys(band, half: int):
    """(n, half * half) int64 table keys: every pair of a band of A and one of B."""
    import numpy as np
    n = len(band)
    at = np.arange(half * half, dtype=np.uint64).reshape(1, half, half)
    pair = _mix(band[:, :half, None] + _mix(band[:, None, half:] + at))
    return pair.reshape(n, half * half).view(np.int64)


def sketches(df: DataFrame, words: int, half: int, width: int) -> DataFrame:
    """(doc_id, content key, n_shingles, set fingerprint, bands) for each row."""
    prepare(df)
    base = df.select("doc_id", *row_key(F.col("text")), "text")

    def run(batches):
        import numpy as np
        for b in batches:
            sets = [shingle_hashes(t, words) for t in b.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], dtype="int64")
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            out = [b""] * len(sets)
            full = np.flatnonzero(n)
            for part in np.array_split(full, max(1, int(n.sum()) // 200_000 + 1)):  # bounds the temporary arrays
                if len(part):
                    some = [sets[i] for i in part]
                    starts = np.cumsum([0, *n[part][:-1]])
                    x = np.concatenate(some)
                    s1[part] = np.add.reduceat(_mix(x + np.uint64(11)), starts)
                    s2[part] = np.add.reduceat(_mix(x ^ np.uint64(0x5DEECE66D)), starts)
                    for i, row in zip(part, bands(some, half, width), strict=True):
                        out[i] = row.tobytes()
            yield b, None, {"n_shingles": n, "__s1": s1.view(np.int64), "__s2": s2.view(np.int64), "__bands": out}

    return map_arrow(base, ["doc_id", "__h1", "__h2"], {
        "n_shingles": T.LongType(), "__s1": T.LongType(), "__s2": T.LongType(), "__bands": T.BinaryType()}, run)


def _key_rows(classes: DataFrame, half: int, extra: tuple[str, ...] = (), own_from: int | None = None,
              shift: int = 0) -> DataFrame:
    """One row for each class and table: (cid, ..., key, i, j) for the table (i, j); with
    ``own_from`` just the tables (i, i + shift), modulo ``half``, with i from that one on."""
    def run(batches):
        import numpy as np
        own = np.arange(own_from or 0, half)
        tables = np.arange(half * half) if own_from is None else own * half + (own + shift) % half
        i, j = np.divmod(tables, half)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                band = np.frombuffer(b"".join(part.column("__bands").to_pylist()), dtype=np.uint64)
                keys = table_keys(band.reshape(part.num_rows, 2 * half), half)[:, tables]
                yield part, np.repeat(np.arange(part.num_rows), len(tables)), {
                    "key": keys.ravel(), "i": np.tile(i, part.num_rows), "j": np.tile(j, part.num_rows)}

    return map_arrow(classes.select("cid", *extra, "__bands"), ["cid", *extra],
                     {"key": T.LongType(), "i": T.ByteType(), "j": T.ByteType()}, run)


def _neighbours(keys: DataFrame, seed: int = 0) -> DataFrame:
    """(u, v, nu, nv, own) for ``keys`` (cid, n, comp, key, i, j): each class of a bucket (v)
    with the bucket's first (u) where their components differ, as often as it occurs; own is
    i in a table (i, i) and -1 in others. The first is the least cid, with a ``seed`` the
    least hash of cid and key, another class in each bucket. Such stars are connected in fewer rounds than
    chains. Buckets are cut at partition borders only, where the next class is first again;
    the two at each border are joined on the driver's side, two rows for each partition."""
    spark = keys.sparkSession
    own = F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(F.lit(-1)).cast("long")
    columns = ["key", "cid", "n", "comp", "own"]
    place = [F.col("key"), *([F.xxhash64(F.lit(seed), "key", "cid")] if seed else []), F.col("cid")]
    ranged = keys.withColumn("own", own).select(*columns).repartitionByRange(shuffle_partitions(spark), *place) \
        .sortWithinPartitions(*place).withColumn("pid", F.spark_partition_id())
    schema = "u long, v long, nu long, nv long, own long, pid int, side int, key long, comp long"
    names = ["u", "v", "nu", "nv", "own", "pid", "side", "key", "comp"]

    def run(batches):
        import numpy as np
        import pandas as pd
        last, pid, ends = None, 0, []
        for b in batches:
            if not len(b):
                continue
            rows = np.stack([b[c].to_numpy() for c in columns])
            pid = int(b["pid"].iloc[0])
            if last is None:
                ends.append((0, rows[1, 0], 0, rows[2, 0], rows[4, 0], pid, 0, rows[0, 0], rows[3, 0]))
            else:
                rows = np.concatenate((last[:, None], rows), axis=1)
            starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            heads = rows[:, np.repeat(starts, np.diff(np.r_[starts, rows.shape[1]]))]
            at = np.flatnonzero(rows[3] != heads[3])
            if len(at):
                yield pd.DataFrame({"u": heads[1, at], "v": rows[1, at], "nu": heads[2, at], "nv": rows[2, at], "own": rows[4, at],
                                    "pid": -1, "side": 0, "key": 0, "comp": 0})
            last = heads[:, -1]
        if last is not None:
            ends.append((last[1], 0, last[2], 0, last[4], pid, 1, last[0], last[3]))
            yield pd.DataFrame(ends, columns=names)

    found = written(ranged.mapInPandas(run, schema))
    ends = sorted(found.filter("pid >= 0").collect(), key=lambda r: (r["pid"], r["side"]))  # 2 a partition
    cross = [(a["u"], b["v"], a["nu"], b["nv"], a["own"]) for a, b in zip(ends[1::2], ends[2::2], strict=False)
             if a["key"] == b["key"] and a["comp"] != b["comp"]]
    links = found.filter("pid < 0").select(*names[:5])
    return links.union(spark.createDataFrame(cross, "u long, v long, nu long, nv long, own long")) if cross else links


def _foreign_shingles(docs: DataFrame, words: int) -> DataFrame:
    """(cid, x) for ``docs`` (cid, comp, text): how many shingles of each class occur
    in another component too. Classes without any have no row."""
    def run(batches):
        import numpy as np
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                sets = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
                yield part, np.repeat(np.arange(len(sets)), [len(x) for x in sets]), {"g": np.concatenate(sets).view(np.int64)}

    rows = map_arrow(docs, ["cid", "comp"], {"g": T.LongType()}, run)
    shared = rows.groupBy("g").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("g")
    return rows.join(shared, "g", "left_semi").groupBy("cid").agg(F.count(F.lit(1)).alias("x"))


def _marks(classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(cid, bands, w0, w1, ..): the bands of ``classes`` as an array of longs, and a
    bitmap of their shingles, one column a word."""
    def run(batches):
        import numpy as np
        for b in batches:
            rows = np.zeros((b.num_rows, 64 * BITMAP), dtype=np.uint8)
            for row, t in zip(rows, b.column("text").to_pylist(), strict=True):
                row[(shingle_hashes(t, words) >> np.uint64(20)).astype(np.int64) % (64 * BITMAP)] = 1
            bits = np.packbits(rows, axis=1).view(np.int64).reshape(b.num_rows, BITMAP)
            bands = [np.frombuffer(x, dtype=np.int64).tolist() for x in b.column("__bands").to_pylist()]
            yield b, None, {"bands": bands, **{f"w{k}": bits[:, k] for k in range(BITMAP)}}

    added = {"bands": T.ArrayType(T.LongType()), **{f"w{k}": T.LongType() for k in range(BITMAP)}}
    return map_arrow(classes.select("cid", "__bands").join(texts.select("cid", "text"), "cid"), ["cid"], added, run)


def _across(open_rows: DataFrame, half: int, percent: int) -> DataFrame:
    """Distinct (u, v, nu, nv) of classes of different components that share a bucket
    of ``open_rows`` (key, i, j, cid, n, comp, x, bands, w0, ..) and pass the bounds. In
    each bucket the component with most rows stands on one side only, so its own pairs
    never meet."""
    counts = open_rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("t")).select("key", F.col("t.comp").alias("top"))
    # bands that come before the table's own two: a pair with one of them in common met earlier
    before = F.concat(F.slice("bands", F.lit(1), F.col("i").cast("int")), F.slice("bands", F.lit(half + 1), F.col("j").cast("int")))
    rows = open_rows.withColumn("before", before).join(top, "key")
    carried = ("cid", "n", "comp", "x", "before", *[f"w{k}" for k in range(BITMAP)])
    left = rows.filter("comp != top").select("key", *[F.col(c).alias(f"{c}u") for c in carried])
    right = rows.select("key", "top", *[F.col(c).alias(f"{c}v") for c in carried])

    def absent(a: str, b: str):
        return sum((F.bit_count(F.col(f"w{k}{a}").bitwiseAND(F.bitwise_not(F.col(f"w{k}{b}")))) for k in range(BITMAP)), F.lit(0))

    def enough(common):
        return common * 100 >= (F.col("nu") + F.col("nv") - common) * percent

    pair = (F.col("compu") < F.col("compv")) | (F.col("compv") == F.col("top")) & (F.col("compu") != F.col("compv"))
    common = F.least(F.col("nu") - absent("u", "v"), F.col("nv") - absent("v", "u"))
    met = left.join(right, "key").filter(pair & enough(F.least("xu", "xv")) & enough(common)
                                         & ~F.arrays_overlap("beforeu", "beforev"))
    swap = F.col("cidu") > F.col("cidv")
    return met.select(F.least("cidu", "cidv").alias("u"), F.greatest("cidu", "cidv").alias("v"),
                      F.when(swap, F.col("nv")).otherwise(F.col("nu")).alias("nu"),
                      F.when(swap, F.col("nu")).otherwise(F.col("nv")).alias("nv")).distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) of the pairs whose full sets are similar enough. Pairs whose sizes
    alone rule it out are left out before any text is moved."""
    low, high = F.least("nu", "nv"), F.greatest("nu", "nv")
    possible = pairs.filter(low * 100 >= high * percent)
    both = possible.join(texts.select(F.col("cid").alias("u"), F.col("text").alias("tu")), "u") \
        .join(texts.select(F.col("cid").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")

    def run(batches):
        import numpy as np
        kept: dict[int, object] = {}

        def of(cid, text):
            if cid not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[cid] = shingle_hashes(text, words)
            return kept[cid]

        for b in batches:
            good = []
            for u, v, tu, tv in zip(b["u"], b["v"], b["tu"], b["tv"], strict=True):
                x, y = of(u, tu), of(v, tv)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= percent * (len(both) - common))
            yield b.loc[good, ["u", "v"]]

    return both.mapInPandas(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of ``links`` (u, v) reaches.

    In each round every node ties itself and all its neighbours to the least of them;
    paths shrink at least to a half or so. The end is reached when no node has two
    smaller neighbours, or neighbours on both sides: then all ties are stars. A round
    is a grouped minimum, a join and a distinct, written to the shared folder."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"),
                                            F.count_if(F.col("v") > F.col("u")).alias("above")))
        if low.filter("below > 1 or (below = 1 and above > 0)").isEmpty():
            break
        tied = both.join(low.select("u", F.least("u", "m").alias("m")), "u") \
            .select("m", F.explode(F.array("u", "v")).alias("u")).filter("u != m")
        edges = written(tied.select("u", F.col("m").alias("v")).distinct())
    return low.select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))


def _joined(of: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the components of ``of`` (cid, comp) after joining those that
    ``links`` (u, v), pairs of cid, connect."""
    place = of.select("cid", "comp")
    ties = links.join(place.select(F.col("cid").alias("u"), F.col("comp").alias("cu")), "u") \
        .join(place.select(F.col("cid").alias("v"), F.col("comp").alias("cv")), "v") \
        .select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    moved = components(ties).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return place.join(moved, "comp", "left").select(F.col("cid").alias("node"), F.coalesce("to", "comp").alias("comp"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, half: int = 10, width: int = 2) -> DataFrame:
    """(doc_id, content key, n_shingles, component_id, kept) for each row of
    ``df`` (doc_id, text): texts are linked when 100 * intersection >= percent *
    union of their sets of ``words``-word shingles (A-Z lower-cased).

    component_id is the least doc_id that links reach. One row of each component
    is kept: that with this doc_id (of repeated rows one). A null or wordless
    text has an empty set and is linked with nothing: it is its own component and
    kept. A null doc_id is above every other. An empty table gives an empty
    result; other columns are not read."""
    rows = written(sketches(df, words, half, width).withColumn("__rid", F.monotonically_increasing_id()))
    mark = ["__s1", "__s2", "n_shingles"]
    low = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__h1", "__h2"))
    classes = written(rows.filter("n_shingles > 0").groupBy(*mark).agg(low.alias("rep"), F.first("__bands").alias("__bands"))
                      .withColumn("cid", F.monotonically_increasing_id()))
    sizes = classes.select("cid", F.col("n_shingles").alias("n"))
    near = _neighbours(_key_rows(classes.withColumns({"n": F.col("n_shingles"), "comp": F.col("cid")}), half, ("n", "comp")))
    met = written(near.select(F.explode(F.array("u", "v")).alias("cid")).distinct())
    reps = classes.join(met, "cid", "left_semi").select(
        "cid", F.col("rep.doc_id").alias("__d"), F.col("rep.__h1").alias("__g1"), F.col("rep.__h2").alias("__g2"))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2"))
    texts = written(keyed(df.select("doc_id", "text")).join(reps, on).select("cid", "text").dropDuplicates(["cid"]))
    comp = components(_confirm(near.filter("own = 0").drop("own"), texts, words, percent))
    # in the other tables (i, i), those that this left apart
    placed = written(classes.join(met, "cid", "left_semi").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                     .select("cid", F.col("n_shingles").alias("n"), F.coalesce("comp", "cid").alias("comp"), "__bands"))
    apart = _neighbours(_key_rows(placed, half, ("n", "comp"), own_from=1)).drop("own").distinct()
    comp = written(_joined(placed, _confirm(apart, texts, words, percent)))
    # while tables (i, i + shift) still join many, with other firsts: each round compares as many pairs as it has rows at most
    for shift in range(1, half):
        placed = written(placed.drop("comp").join(comp.withColumnRenamed("node", "cid"), "cid").select("cid", "n", "comp", "__bands"))
        apart = written(_neighbours(_key_rows(placed, half, ("n", "comp"), 0, shift), shift).drop("own").distinct())
        links = written(_confirm(apart, texts, words, percent))
        found = links.count()
        if found:
            comp = written(_joined(placed, links))
        if found * FEW <= apart.count():
            break

    # buckets that still hold more than one component
    inside = written(classes.join(met, "cid", "left_semi").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                     .select("cid", F.col("n_shingles").alias("n"), F.coalesce("comp", "cid").alias("comp"), "__bands"))
    tabled = _key_rows(inside, half, ("n", "comp"))
    mixed = written(tabled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("key"))
    open_rows = written(tabled.join(mixed, "key", "left_semi"))
    docs = open_rows.select("cid", "comp").distinct().join(texts, "cid")
    foreign = written(_foreign_shingles(docs, words).join(sizes, "cid").filter(F.col("x") * 100 >= F.col("n") * percent)
                      .select("cid", "x"))
    marks = _marks(inside.join(foreign, "cid", "left_semi"), texts, words).join(foreign, "cid")
    more = _confirm(_across(open_rows.join(written(marks), "cid"), half, percent), texts, words, percent)
    more = written(more)
    if not more.isEmpty():
        comp = written(_joined(inside, more))

    named = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left") \
        .select(*[F.col(c).alias(f"_{c}") for c in mark], F.coalesce("comp", "cid").alias("__comp"))
    on = (F.col("__s1") == F.col("___s1")) & (F.col("__s2") == F.col("___s2")) & (F.col("n_shingles") == F.col("_n_shingles"))
    full = rows.filter("n_shingles > 0").drop("__bands").join(named, on).drop("___s1", "___s2", "_n_shingles")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__rid")
    heads = full.groupBy("__comp").agg(F.min(place).alias("head"))
    grouped = full.join(heads, "__comp").select(
        "doc_id", "__h1", "__h2", "n_shingles", F.col("head.doc_id").alias("component_id"),
        (F.col("__rid") == F.col("head.__rid")).alias("kept"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "__h1", "__h2", "n_shingles",
                                                 F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(empty)
