"""Token alignment against loops over the tokenizers' own output."""
import collections
import hashlib
import random

import frames
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabsight.llm import queries, token_align

TEXTS = [None, "", "a", " a ", "x" * 300, "hello <|endoftext|> </s> ü 日本語テキスト😀", "a▁b", "\x00\x01", "ﬁ \r\n\t  y", " " * 50,
         "don't we'll they'S 123456 --- ==== \n\n\n", "ß" * 40, "Привет мир как дела", "line\n\nline \n  end  "]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def one(plain, text):
    """(ids of A, ids of B, groups as text, linked places) of one text by plain loops."""
    a, b = plain
    ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
    ends = []
    spelled = [[bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                for p in map(b.id_to_piece, ids_b)]]
    plain_byte = {chr(k): k for k in range(256) if 0x21 <= k < 0x7F or 0xA1 <= k < 0xAD or k >= 0xAE}
    rest = iter(range(256, 512))
    code = plain_byte | {chr(next(rest)): k for k in range(256) if chr(k) not in plain_byte}
    spelled.insert(0, [bytes(code[c] for c in t) for t in ids_a.tokens])
    if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
        return [], [], "", []
    for s in spelled:
        ends.append(np.cumsum([len(x) for x in s]).tolist())
    ids, cuts, groups, i, j = (ids_a.ids, ids_b), sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for c in cuts:
        i2, j2 = ends[0].index(c) + 1, ends[1].index(c) + 1
        groups.append(",".join(map(str, ids[0][i:i2])) + "|" + ",".join(map(str, ids[1][j:j2])))
        i, j = i2, j2
    starts = [[0, *e] for e in ends]
    linked = [(x, y) for x in range(len(ends[0])) for y in range(len(ends[1]))
              if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
    return ids[0], ids[1], ";".join(groups), linked


def digests(plain, rows):
    """The query's rows for (doc_id, text) rows."""
    found = [one(plain, t) for _, t in rows]
    pairs = [collections.Counter((a[i], b[j]) for i, j in linked) for a, b, _, linked in found]
    docs = collections.Counter(p for c in pairs for p in c)
    top = collections.defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    return collections.Counter(
        (d, len(a), len(b), len(g.split(";")) if g else 0, len(linked), sum(n for p, n in c.items() if docs[p] == top[p[0]]),
         sum(n * docs[p] for p, n in c.items()), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for (d, _), (a, b, g, linked), c in zip(rows, found, pairs, strict=True))


def mixed(seed, n):
    rng = random.Random(seed)
    some = ["a", "the", " ", "  ", "\n", "日", "é", "😀", "12", "ing", "Th", "#", "　", "и", "▁", "<s>", "ation"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_aligner(plain):
    texts = TEXTS + mixed(3, 150)
    for text, got in zip(texts, token_align.Aligner(*queries.two_tokenizers()).align(texts), strict=True):
        a, b, groups, linked = one(plain, text)
        assert (got[0].tolist(), got[1].tolist(), got[5].decode(), got[4]) == (a, b, groups, len(linked))
        assert (got[2].tolist()[-1:], got[3].tolist()[-1:]) == ([len(a)] * bool(a), [len(b)] * bool(a))


def test_leaf_groups_without_near_cuts():
    """Two long texts whose only common ends lie far apart, and one without any inside."""
    a = np.r_[0:2001:2, 2003, 2006]
    b = np.r_[0, 1:2000:2, 2000, 2001, 2006]
    wide = np.array([0, len(a) - 1]), np.array([0, len(b) - 1])
    ends_a, ends_b = token_align.leaf_groups(a, b, *wide)
    assert a[ends_a].tolist() == b[ends_b].tolist() == [2000, 2006]
    i, j = token_align.links(a, b)
    want = [(x, y) for x in range(len(a) - 1) for y in range(len(b) - 1) if a[x] < b[y + 1] and b[y] < a[x + 1]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_fast_split_equals_the_file(plain):
    fast = queries.two_tokenizers()[0]
    letters = "".join(map(chr, range(1, 0x250)))
    texts = [letters, " ".join(letters), *frames.rows()[0][1:2], "a  b\t\tc \n\n d", "end  ", "'s 's't've it's"] + mixed(8, 100)
    assert fast.encode(texts) == [plain[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [None, 40_000])
def test_query_on_awkward_rows(spark, plain, limit):
    """Also with a broadcast limit that deals the counts into many blocks."""
    rows = [(r[0], r[1]) for r in frames.rows() if r[0] not in (13, 14, 17)] + [(700 + k, t) for k, t in enumerate(TEXTS + mixed(9, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) \
        .withColumns({c: F.lit(1) for c in ("pair", "docs", "best", "n_a", "a_ids", "n_best")})
    if limit:
        spark.conf.set("tabsight.broadcastBytes", str(limit))
    try:
        got = token_align.aligned_digests(df, queries.two_tokenizers).collect()
    finally:
        spark.conf.unset("tabsight.broadcastBytes")
    assert collections.Counter(map(tuple, got)) == digests(plain, rows)
    assert token_align.aligned_digests(df.limit(0), queries.two_tokenizers).count() == 0


def test_alignment_columns(spark):
    df = spark.createDataFrame([(1, "Hello wörld again"), (2, None)], "doc_id long, text string")
    row, empty = token_align.alignments(df, queries.two_tokenizers).orderBy("doc_id").collect()
    a, b = queries.two_tokenizers()
    ids = np.frombuffer(row["a_ids"], "<u2"), np.frombuffer(row["b_ids"], "<u2")
    text = [b"".join(t.token_bytes[i] for i in some) for t, some in zip((a, b), ids, strict=True)]
    assert text == [" Hello wörld again".encode()] * 2 and row["n_groups"] == len(np.frombuffer(row["a_ends"], "<i4"))
    assert not empty["a_ids"] and empty["n_links"] == 0 and empty["groups_sha256"] == ""


def test_places_from_a_table_or_by_search():
    for b in ([0, 2, 3, 7, 9], [0, 2, 2, 3, 9]):  # a repeated place: a token without bytes
        sb = np.array(b)
        below, upto = token_align._counter(sb, 9)
        at = np.arange(10)
        assert below(at).tolist() == np.searchsorted(sb, at).tolist()
        assert upto(at).tolist() == np.searchsorted(sb, at, side="right").tolist()
    i, j = token_align.links(np.array([0, 3, 4, 9]), np.array([0, 2, 3, 7, 9]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2), (2, 3)]
