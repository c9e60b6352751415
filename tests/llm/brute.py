"""Brute-force versions of the operators' results, over lists of rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    """source -> target by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, pot = {}, list(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if pot * w[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: pot * w[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        pot -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def exact(rows):
    """rows (doc_id, text) -> {doc_id: (keep_id, group_size, kept, sha256)}"""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(FOLD)].append(d)
    return {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def shingles(text, n):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near(rows, n, percent=80):
    """{doc_id: (n_shingles, component_id, kept)} by an inverted index over all pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in rows}
    index = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    common = collections.Counter()
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            links += 1
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}, links


def chats(rows):
    """rows (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    count = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if count[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def pages(rows):
    """rows (page_id, html) -> {page_id: (payload_bytes, digest, record_type, refers_to)}"""
    first = {}
    for p, h in rows:
        first[h or ""] = min(p, first.get(h or "", p))
    return {p: (len(raw := (h or "").encode()), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, h in rows}


def token_pieces(rows, tokenizer, capacity):
    """{(doc_id, piece): (start, length, crc32)}"""
    import struct
    out = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0] if len(ids) <= capacity else sorted({0, *range(len(ids) % capacity, len(ids), capacity)})
        for k, s in enumerate(cuts):
            part = ids[s:(cuts + [len(ids)])[k + 1]]
            out[d, k] = (s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    return out
