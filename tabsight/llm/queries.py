"""Registered queries of the operators, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_extract, jaccard_join, langid, mixing, near_dedup, packing, periodic, pii, quality, token_align, warc
from .common import WORD_PATTERN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing")
def op1(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")) \
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


#: Fixed values of the SQL: words, and lower-casing of A-Z.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Groups by the normalised text itself.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")) \
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_pii_surrogates")
def op3(spark, sf_dir):
    return pii.surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


#: All pairs that share a shingle, and everything reachable from each document.
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m),
k AS (SELECT d, min(m) AS m FROM r GROUP BY d)
SELECT k.d AS doc_id, coalesce(n.n, 0) AS n_shingles, k.m AS component_id, k.d = k.m AS kept
FROM k LEFT JOIN n ON n.doc_id = k.d
"""


@query("op4_near_dedup", OP4_SQL)
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4) \
        .select("doc_id", "n_shingles", "component_id", "kept")


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"


OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, 14 + length(replace({_escaped('role')}, ':', '\\:')) + length({_escaped('x')}) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x) AS turns,
        coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum(n) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query("op5_chat_format", OP5_SQL)
def op5(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], c.schema)
    return chat.digests(chat.format_turns(c.unionByName(extra), window=chat.MARKED_LOOK_BACK))


def _op6_sql() -> str:
    """The measures in SQL, and a condition for each row of the rules' table."""
    q = lambda x: x.replace("'", "''")
    stop = ", ".join(f"'{q(w)}'" for w in sorted(set(quality.STOP_WORDS)))
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END AS {name}" for name, (a, b) in quality.RATIOS.items())
    broken = " OR ".join(
        f"(n_words >= {r.min_words} AND ({' OR '.join(c for c in (f'{r.measure} < {r.low}' if r.low is not None else '', f'{r.measure} > {r.high}' if r.high is not None else '') if c)}))"
        for r in quality.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format('t')} AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'x': array_to_string(w[i:i + 7], ' ')}})) AS z FROM w),
g AS (SELECT doc_id, z.i AS i, count(*) OVER (PARTITION BY doc_id, z.x) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 8) r(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: {_LOWER.format('x')} IN ({stop}))) AS n_stop_words,
        len(list_filter(l, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '{quality.ELLIPSIS}'))) AS n_ellipsis_lines
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM x
"""


@query("op6_quality_rules", _op6_sql())
def op6(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The digest's 40 hex digits as bits, five of which make a base-32 digit.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, sha1(h) AS hex FROM p),
b AS (SELECT page_id, h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM x),
d AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + 16 * CAST(bits[5 * j + 1] AS INTEGER) + 8 * CAST(bits[5 * j + 2] AS INTEGER) + 4 * CAST(bits[5 * j + 3] AS INTEGER)
          + 2 * CAST(bits[5 * j + 4] AS INTEGER) + CAST(bits[5 * j + 5] AS INTEGER)]), '') AS digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op7_warc", OP7_SQL)
def op7(spark, sf_dir):
    folder = warc.archive_folder(spark)
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, folder).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


@query("op8_html_text")
def op8(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def byte_bpe():
    """The tokenizer of the packing query; made in the tasks."""
    import public_tokenizers as p
    return packing.Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe, capacity=2048, end_id=0).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_language_id")
def op10(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = d.withColumn("held_out", held)
    return langid.identify(docs.drop("lang"), train_on=docs.filter("not held_out")) \
        .select("doc_id", "held_out", "lang_pred", "score")


#: All pairs that share a shingle, and everything reachable from each document.
OP11_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m),
k AS (SELECT d, min(m) AS m FROM r GROUP BY d)
SELECT k.d AS doc_id, coalesce(n.n, 0) AS n_shingles, k.m AS component_id
FROM k LEFT JOIN n ON n.doc_id = k.d
"""


@query("op11_jaccard_join", OP11_SQL)
def op11(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90) \
        .select("doc_id", "n_shingles", "component_id")


#: The split of the byte-level vocabulary with possessive repeats: the same pieces, found faster.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def two_tokenizers():
    """The tokenizers of the alignment query; made in the tasks."""
    import public_tokenizers as p
    return (token_align.byte_level(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), PATTERN),
            token_align.pieces(p.path("piece_bpe_32k.model")))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_align.aligned_digests(table(spark, sf_dir, "documents"), two_tokenizers)


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; where crc32 of the decimal doc_id is a multiple of ten,
    words from a on repeat the p words from there: the query's input."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    planted = docs.select("doc_id", "text", h.alias("h")) \
        .withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")) \
        .withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(
        "w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return planted.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic.digests(periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents"))))
