"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is an expression over the whole text and every rule a row of a
table; :func:`verdicts` turns table and measures into columns of one select. No
user function, join or exchange takes part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is it for was on are as with be at by this have from or an not "
    "der die und den das von ist mit des im zu ein eine auf nicht als auch sich dem "
    "le la les de et un une que est du dans pour qui sur pas au ce il avec par "
    "el los las y por con una se del su al lo como para más en").split()

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 8
BULLET, ELLIPSIS = r"^ *[-*•][ \t]", r"(\.\.\.|…) *\z"


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` lies outside [low, high]; the rule holds
    for documents of ``min_words`` words or more."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Bounds are wide: they are to reject lists, tables, shouting and symbol noise,
#: and to leave prose of the four languages alone.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("stop_words", "stop_word_ratio", low=0.02, min_words=40),
    Rule("line_repeats", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.5),
)


#: measure -> (count, per): how the ratios of the table are made.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used: a
    one-element transform. What a lambda uses must be a variable bound so, or it is
    evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, by sorting (hash,
    place) pairs: equal neighbours mark their places, and places in order cover
    min(8, distance to the next marked place) words each. ``words`` must be bound."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))) \
        .otherwise(F.array().cast("array<int>"))
    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(
        starts, lambda i: F.xxhash64(*[F.get(hs, i + (k - 1)) for k in range(WINDOW)])))

    def marked(ps: Column) -> Column:
        def hit(p: Column, k: Column) -> Column:
            before, after = F.get(ps, k - 1)["h"], F.get(ps, k + 1)["h"]
            return F.when(F.coalesce(before == p["h"], F.lit(False)) | F.coalesce(after == p["h"], F.lit(False)), p["i"])
        return F.array_sort(F.filter(F.transform(ps, hit), lambda x: x.isNotNull()))

    def spread(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def covered(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(_let(pairs, marked), spread)

    return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
                .otherwise(covered(hs)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
            "n_bullet_lines", "n_ellipsis_lines")


def _measured(parts: Column) -> Column:
    """The counts of a text from its (t, w, l): text, words, lines with a word."""
    t, w, k = parts["t"], parts["w"], parts["l"]
    stop = sorted(set(STOP_WORDS))
    counts = (F.size(w), F.length(F.array_join(w, "")), F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", "")),
              F.size(k) - F.size(F.array_distinct(k)), _repeat_words(w), F.size(k),
              F.size(F.filter(w, lambda x: ascii_lower(x).isin(*stop))), F.size(F.filter(k, lambda x: x.rlike(BULLET))),
              F.size(F.filter(k, lambda x: x.rlike(ELLIPSIS))))
    return F.struct(*[c.cast("long").alias(n) for n, c in zip(MEASURES, counts, strict=True)])


def compile_rules(rules: Sequence[Rule], measure) -> Column:
    """The names of the rules that are broken, as one expression; ``measure(name)``
    is the column of a measure."""
    def broken(r: Rule) -> Column:
        x, out = measure(r.measure), F.lit(False)
        if r.low is not None:
            out = out | (x < r.low)
        if r.high is not None:
            out = out | (x > r.high)
        return F.when(out & (measure("n_words") >= r.min_words), F.lit(r.name))

    return F.filter(F.array(*[broken(r) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull())


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Measures, ratios, base_failed, broken and kept of a text, as one struct: the
    whole table in a single expression that is evaluated once for each row."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(t.alias("t"), F.filter(F.split(t, SPLIT), lambda w: w != "").alias("w"),
                     F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))

    def with_ratios(m: Column) -> Column:
        ratios = [F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0)).alias(name) for name, (a, b) in RATIOS.items()]
        return F.struct(*[m[n].alias(n) for n in MEASURES], *ratios)

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30)
        return F.struct(*[m[n].alias(n) for n in (*MEASURES, *RATIOS)], base.alias("base_failed"),
                        compile_rules(rules, lambda n: m[n]).alias("broken"))

    def decided(m: Column) -> Column:
        return F.struct(*[m[n].alias(n) for n in (*MEASURES, *RATIOS, "base_failed", "broken")],
                        (~m["base_failed"] & (F.size(m["broken"]) == 0)).alias("kept"))

    return _let(_let(_let(_let(parts, _measured), with_ratios), judged), decided)


def verdicts(df: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, measures, ``base_failed``, ``broken`` (names of broken
    rules) and ``kept`` for each row of ``df`` (doc_id, text).

    The base rules: fewer than 20 words, or over 30 % of the words inside 8-word
    windows that occur twice or more. A document is kept if it passes these and
    every rule of the table. A null or empty text has no words and is rejected.
    Null ids and repeated rows are rows like others; an empty table gives an
    empty result; columns outside ``keep`` and text are not read."""
    return df.select(*[F.col(f"`{c}`") for c in keep], verdict(F.col("text"), rules).alias("__v")) \
        .select(*[F.col(f"`{c}`") for c in keep], "__v.*")


def kept_documents(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that :func:`verdicts` keeps, with its columns."""
    return df.filter(verdict(F.col("text"), rules)["kept"])
