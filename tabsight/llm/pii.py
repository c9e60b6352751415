"""PII surrogates by DataFrame functions only.

Entities are found with one pattern. Each gets a replacement drawn from a keyed
hash of its canonical form, so equal entities agree everywhere (coreference), in
whatever way they are written: e-mail case, phone and card punctuation and name
titles don't matter. Replacements keep type and format: digits stay digits,
letters keep their case, card check digits and octet ranges stay valid, e-mail
domains keep their labels, given names keep gender and script.

Distinct entities must stay distinct: the canonical forms of the whole corpus are
checked against each other and against each other's replacements, and those that
collide are drawn again under the next salt until none does. A format that is full
or nearly so can't give every entity a form of its own: what still collides after
some draws gets a wider format, by one more digit, letter or syllable for each
further draw. The few salts that aren't 0 are joined to the documents that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, prepare, shuffle_partitions, written

#: Common given names by (script, gender), and letters for invented
#: surnames by script.
GIVEN = {
    ("latin", "f"): ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Sophia Anna Laura "
                     "Maria Julia Claire Camille Isabelle Nathalie Carmen Lucia Elena Ingrid Heike Sabine Katharina").split(),
    ("latin", "m"): ("James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Peter Paul "
                     "Martin Hans Klaus Jürgen Wolfgang Pierre Jacques Antoine Carlos Miguel Javier Antonio Fernando").split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Χρήστος Αθανάσιος".split(),
}
TITLES_F = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Lady".split()
TITLES_M = "Mr Herr Monsieur Señor Sr Don Sir".split()
TITLES_ANY = "Dr Prof".split()
SYLLABLES = {
    "latin": "ba den fir gol har kel lor mar nes pol rin sal tor ven wal zim".split(),
    "cyrillic": "бар вел гор дан кол лев мор нов пет рог сол тар фед хол чер шум".split(),
    "greek": "βαρ γαλ δημ ζαν καλ λαμ μαν νικ παλ ραπ σαρ ταν φιλ χαρ ψαρ θεο".split(),
}

WORD = r"\p{Lu}[\p{L}'’-]+"
SURNAME = rf"(?:(?:van|von|de|der|la|del) ){{0,2}}{WORD}"
_given = "|".join(n for names in GIVEN.values() for n in names)
_titles = "|".join([*TITLES_F, *TITLES_M, *TITLES_ANY])

#: What follows a plus or an opening bracket in a number with a decimal point or
#: thousands marks, not a phone. Nine digits after a point are a phone (+1.2125550182).
_SIGNED = (r"(?!\d+\.\d{1,8}(?!\d|\.\d|[\-/]\d{3,4}(?!\d|\.\d))|\d{1,3}(?: \d{3})+\.\d{1,2}(?!\d|[ .\-/]\d)"
           r"|\d{1,3}(?:\.\d{3})+,\d)")
_BRACKETED = r"(?!\d+\) ?\d+\.\d{1,3}(?!\d|[ .\-/]\d))"
#: At least seven digits lie before this place.
_SEVEN = r"(?<=\d" + r"[ .\-/()]{0,3}\d" * 6 + r"\)?)"
_NINE = r"(?<=\d" + r"[ .\-/()]{0,3}\d" * 8 + r"\)?)"
#: Phones as written inside a country: trunk 1; 00 and a country code; 0 and pairs of
#: digits; 0, an area code and nine digits or more in all; pairs of digits without a 0.
_NATIONAL = (r"(?=[016-9])(?<!\d[.,])(?<![\w\-+])(?:1[.\- ]\(?\d{3}\)?[.\- ]\d{3}[.\- ]\d{4}"
             r"|00[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,8}\)?){2,6}" + _NINE + r"|0[1-9](?:[ .\-]\d{2}){4}"
             r"|0[1-9]\d{1,4}(?:[ \-]| ?/ ?)\d{2,8}(?: \d{2,8}|-\d{1,6}){0,3}" + _NINE +
             r"|(?:[89]\d[ .\-]\d{3}|[6-9]\d{2}[ .\-]\d{2})[ .\-]\d{2}[ .\-]\d{2})(?!\w|-\d)")
#: Compressed IPv6 in the ranges given out; a[1::2] and std::min aren't.
_SHORT_IPV6 = (r"(?=[236fF])(?<![\w:.])(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))(?=[A-Fa-f:]*\d)"
               r"(?:[23][0-9A-Fa-f]{3}|[Ff][C-Fc-f][0-9A-Fa-f]{2}|64:[Ff]{2}9[Bb])(?::[0-9A-Fa-f]{1,4}){0,6}::"
               r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")

#: type -> Java pattern, in order of precedence.
PATTERNS = {
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{8,}",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
          rf"|{_SHORT_IPV6}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": rf"(?<![\w+])\+{_SIGNED}\d{{1,3}}(?:[ .\-/]?\(?\d{{1,4}}\)?){{2,6}}{_SEVEN}(?!\w)"
             rf"|(?<!\w)\({_BRACKETED}\d{{2,5}}\)[ .\-/]?\d{{3,4}}(?:[ .\-/]?\d{{2,4}}){{1,3}}(?!\w)"
             rf"|(?<![\w.\-])\d{{3}}[.\- ]\d{{3}}[.\- ]\d{{4}}(?![\w\-])|{_NATIONAL}",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "person": rf"(?<![\p{{L}}])(?:(?:{_titles})\.? (?:(?:{_given}) )?{SURNAME}|(?:{_given}) {SURNAME})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity.
HINT = rf"[@0-9]|(?i:password|passwd|pwd|secret|token|key)|(?<![\p{{L}}])(?=\p{{Lu}})(?:{_titles}|{_given})\b"


def entity_type(e: Column) -> Column:
    """The first type of the table whose pattern matches the whole entity."""
    out = F.lit("other")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(e.rlike(rf"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


#: Country calling codes, by which a number's first digits stay however it is spaced.
_CODE = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _dialled(e: Column) -> Column:
    """A phone's digits, after a plus if it has a country code, be it after 00 or
    the trunk 1."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.when(e.startswith("+") | e.rlike(r"^1[.\- ]"), F.concat(F.lit("+"), digits)) \
        .when(digits.startswith("00"), F.regexp_replace(digits, "^00", "+")).otherwise(digits)


def _kept(e: Column) -> Column:
    """How many digits of :func:`_dialled` stay: the country code, the trunk 0 or
    the digit by which nine digits are known as a phone."""
    d = _dialled(e)
    return F.when(d.startswith("+"), F.length(F.regexp_extract(d, _CODE, 1))).when(d.rlike(r"^(?:0|[6-9]\d{8}$)"), 1).otherwise(0)


def _canonical(e: Column, kind: Column) -> Column:
    """What two spellings of one entity have in common, with the type in front.
    A person's is its surname: titles and given names are replaced word by word."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.concat(kind, F.lit("|"), F.when(kind.isin("email"), F.lower(e)).when(kind == "phone", _dialled(e)).when(kind == "card", digits)
                    .when(kind == "iban", F.regexp_replace(e, " ", ""))
                    .when(kind == "secret", F.regexp_replace(e, r"^.*[=:]\s{0,3}[\"']?", ""))
                    .when(kind == "person", F.regexp_extract(e, rf"({SURNAME})$", 1)).otherwise(e))


def surname_of(person: Column) -> Column:
    return F.regexp_replace(person, rf"^(?:(?:{_titles})\.? )?(?:(?:{_given}) )?", "")


def canonical(e: Column, kind: Column) -> Column:
    return F.when(kind == "person", F.concat(F.lit("person|"), surname_of(e))).otherwise(_canonical(e, kind))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hex stream, which is used round and round."""
    at = (i % (F.length(stream) / 2).cast("int")) * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _like(e: Column, stream: Column, skip: int | Column = 0) -> Column:
    """``e`` with each digit and ASCII letter after the first ``skip`` characters
    replaced in kind."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1))
        return F.when(i < skip, c).when(c.rlike("[0-9]"), (b % 10).cast("string")) \
            .when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
    return F.array_join(F.transform(F.split(e, ""), one), "")


def _hex_like(e: Column, stream: Column) -> Column:
    """Hexadecimal secrets stay hexadecimal."""
    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9a-f]"), F.lower(F.conv(_byte(stream, i) % 16, 10, 16))).otherwise(c)
    return F.array_join(F.transform(F.split(e, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check rule over digits, the last one counted once; 0 modulo 10 if valid."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(ds, F.lit(0), lambda a, x: a + x) % 10


def _digits_back(shape: Column, digits: Column) -> Column:
    """The digits put into the digit places of ``shape``."""
    spots = F.transform(F.split(shape, ""), lambda c: F.when(c.rlike("[0-9]"), F.lit(1)).otherwise(F.lit(0)))
    places = F.transform(spots, lambda s, i: F.aggregate(F.slice(spots, 1, i + 1), F.lit(0), lambda a, x: a + x))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.get(places, i), F.lit(1))).otherwise(c)), "")


def _stream(key: str, canon: Column, salt: Column) -> Column:
    return F.concat(F.sha2(F.concat_ws("\x1f", F.lit(key), salt.cast("string"), canon), 256),
                    F.sha2(F.concat_ws("\x1f", F.lit(key + "'"), salt.cast("string"), canon), 256))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _surname(word: Column, stream: Column, wider: Column) -> Column:
    """An invented surname of four syllables and ``wider`` more in the word's script."""
    def syllable(parts: list[str]):
        return lambda k: F.element_at(F.array(*[F.lit(p) for p in parts]), _byte(stream, k) % len(parts) + 1)

    made = None
    for script, parts in SYLLABLES.items():
        name = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), wider + 3), syllable(parts)), ""))
        made = F.when(_script(word) == script, name) if made is None else made.when(_script(word) == script, name)
    return made


def _given_name(word: Column, key: str) -> Column:
    """A keyed rotation of the table of the name's gender and script: one to one,
    and never the name itself."""
    import hashlib
    out = F.lit("")
    for (script, gender), names in GIVEN.items():
        shift = 1 + int(hashlib.sha256(f"{key}{script}{gender}".encode()).hexdigest(), 16) % (len(names) - 1)
        table = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, names[(k + shift) % len(names)])])
        out = F.when(word.isin(*names), F.element_at(table, word)).otherwise(out)
    return out


def surrogate(e: Column, kind: Column, canon: Column, salt: Column, key: str) -> Column:
    """The replacement of one entity: a function of its canonical form, put into
    the form in which the entity is written, or into one that is wider by as many
    characters as ``salt`` holds :data:`WIDER`."""
    # bound once: without that, each character would compute them again
    wider = (salt / WIDER).cast("int")
    wide = F.concat(e, F.when(kind.isin("email", "person"), "").when((kind == "ip") & ~e.contains(":"), F.repeat(F.lit(".0"), wider))
                    .otherwise(F.repeat(F.lit("0"), wider)))
    bound = F.struct(e.alias("e"), wide.alias("wide"), kind.alias("kind"), wider.alias("wider"), _stream(key, canon, salt).alias("s"),
                     F.regexp_replace(wide, r"\D", "").alias("digits"))
    return F.get(F.transform(F.array(bound), lambda b: _drawn(b, key)), F.lit(0))


def _drawn(b: Column, key: str) -> Column:
    short, e, kind, wider, s, digits = (b[n] for n in ("e", "wide", "kind", "wider", "s", "digits"))
    more = F.repeat(F.lit("0"), wider)
    valid = _luhn(F.regexp_replace(short, r"\D", "")) == 0
    # e-mail: the local part by the whole address, each domain label but the last by itself
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    labels = F.split(F.lower(domain), r"\.")
    new_labels = F.transform(labels, lambda x, i: F.when(i == F.size(labels) - 1, x).otherwise(
        _like(x, _stream(key, F.concat(F.lit("label|"), x), F.lit(0)))))
    email = F.concat(_like(F.concat(F.lower(local), more), s), F.lit("@"), F.array_join(new_labels, "."))
    # phone: a country code stays; no group of the rest gets another length
    abroad = F.when(~short.startswith("+") & digits.startswith("00"), 2).otherwise(0)
    phone = _digits_back(e, F.concat(F.left(digits, abroad), _like(F.substring(digits, abroad + 1, F.length(digits)), s, _kept(short))))
    # card: the first digit stays; a valid check digit is made valid again
    body = F.concat(_like(F.left(digits, F.length(digits) - 1), s, 1), F.lit("0"))
    check = F.when(valid, ((10 - _luhn(body)) % 10).cast("string")).otherwise(
        F.conv((_byte(s, F.lit(30)) % 9 + 1 + (10 - _luhn(body)) % 10) % 10, 10, 10))
    card = _digits_back(e, F.concat(F.left(body, F.length(body) - 1), check))
    octets = F.array_join(F.transform(F.split(e, r"\."), lambda x, i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    ip = F.when(e.contains(":"), _hex_like(F.lower(e), s)).otherwise(octets)
    prefix = F.regexp_extract(e, r"^(.*[=:]\s{0,3}[\"']?)", 1)
    value = F.substring(e, F.length(prefix) + 1, F.length(e))
    secret = F.concat(prefix, F.when(value.startswith("AKIA"), _like(value, s, 4))
                      .when(value.rlike("^[0-9a-f]+$"), _hex_like(value, s)).otherwise(_like(value, s)))
    last = surname_of(short)
    head = F.left(short, F.length(short) - F.length(last))
    given = F.regexp_extract(head, rf"({_given}) $", 1)
    person = F.concat(F.left(head, F.length(head) - F.length(given) - F.when(given != "", 1).otherwise(0)),
                      F.when(given != "", F.concat(_given_name(given, key), F.lit(" "))).otherwise(F.lit("")),
                      _surname(last, s, wider))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip) \
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_like(e, s), 2, 20))).when(kind == "secret", secret) \
        .when(kind == "person", person).when(kind == "iban", _like(e, s, 4)).otherwise(_like(e, s))


def entities(text: Column) -> Column:
    """The entities of a text in order, as an array; empty for most texts."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


#: A salt's thousands say by how many characters its format is wider.
WIDER = 1000


def _described(es: Column) -> Column:
    """(e, kind, canon) for each entity."""
    pairs = F.transform(es, lambda e: F.struct(e.alias("e"), entity_type(e).alias("kind")))
    return F.transform(pairs, lambda p: F.struct(p["e"].alias("e"), p["kind"].alias("kind"),
                                                 canonical(p["e"], p["kind"]).alias("canon")))


def salts(found: DataFrame, key: str, max_rounds: int = 16) -> DataFrame:
    """(canon, salt) of the canonical forms of ``found`` (e, kind, canon) that need
    a salt other than 0 for their replacement to differ from every other
    replacement and from every entity found. An entity is drawn at most
    ``max_rounds`` times in its own format; after that, each draw has ten times
    the forms of the one before or more, so a few of them end any collision."""
    spark = found.sparkSession
    # the least spelling stands for all: replacements are compared in canonical form
    forms = written(found.groupBy("canon").agg(F.min(F.struct("e", "kind")).alias("x"))
                    .select("canon", "x.e", "x.kind", F.lit(0).alias("salt"), F.lit(None).cast("string").alias("made")))
    real = forms.select(F.col("canon").alias("made"))
    while True:
        made = surrogate(F.col("e"), F.col("kind"), F.col("canon"), F.col("salt"), key)
        # drawing is dear for its few bytes: dealt out by rows, not by file size
        dealt = forms.repartition(shuffle_partitions(spark), "canon")
        drawn = written(dealt.withColumn("made", F.coalesce("made", canonical(made, F.col("kind")))))
        first = drawn.groupBy("made").agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        again = drawn.join(first, "made").filter("canon != first").select("canon") \
            .union(drawn.join(real, "made", "left_semi").select("canon")).distinct()
        again = written(again)
        if again.isEmpty():
            return forms.filter("salt > 0").select("canon", "salt")
        salt = F.col("salt")
        following = F.when(salt + 1 < max_rounds, salt + 1).otherwise(salt + WIDER)
        forms = written(drawn.join(again.withColumn("hit", F.lit(1)), "canon", "left")
                        .select("canon", "e", "kind", F.when(F.col("hit") == 1, following).otherwise(salt).alias("salt"),
                                F.when(F.col("hit").isNull(), F.col("made")).alias("made")))


def surrogates(df: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """(doc_id, content key, text, n_entities) for each row of ``df`` (doc_id,
    text), with every entity in the whole text replaced.

    A null text stays null and an empty one empty; a text without an entity comes
    back unchanged. Null ids and repeated rows are rows like others; an empty
    table gives an empty result; other columns are not read."""
    prepare(df)
    base = keyed(df.select("doc_id", "text"))
    rows = base.withColumn("__es", _described(entities(F.coalesce("text", F.lit("")))))
    found = written(rows.filter(F.size("__es") > 0).select("doc_id", "__h1", "__h2", F.explode("__es").alias("x"))
                    .select("doc_id", "__h1", "__h2", "x.*").distinct())
    odd = written(salts(found, key))
    own = written(found.join(odd, "canon").select("doc_id", "__h1", "__h2", "canon", "salt").distinct()
                  .groupBy("doc_id", "__h1", "__h2").agg(F.map_from_entries(F.collect_list(F.struct("canon", "salt"))).alias("__salts"))
                  .withColumnsRenamed({"doc_id": "__d", "__h1": "__g1", "__h2": "__g2"}))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2"))
    joined = rows.join(own, on, "left")
    new = F.transform("__es", lambda x: surrogate(
        x["e"], x["kind"], x["canon"], F.coalesce(F.element_at("__salts", x["canon"]), F.lit(0)), key))
    gaps = F.split("text", ANY, -1)
    text = F.when(F.size("__es") > 0, F.array_join(F.flatten(F.zip_with(
        gaps, new, lambda g, e: F.array(g, F.coalesce(e, F.lit(""))))), "")).otherwise(F.col("text"))
    return joined.select("doc_id", "__h1", "__h2", text.alias("text"), F.size("__es").cast("long").alias("n_entities"))
