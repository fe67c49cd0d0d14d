"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = {i: i + 32 for i in range(65, 91)}


def fold(text: str | None) -> str:
    return (text or "").translate(UPPER)


def near_duplicates(docs: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        for a in ids:
            common.update((a, b) for b in ids if a < b)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def base_license_places(text: str | None) -> tuple:
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def without_repeats(docs: list[tuple], span: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) in order."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + span] for _, b in raw for k in range(len(b) - span + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut_texts(docs: list[tuple], span: int = 200) -> dict:
    """doc_id -> text without its repeated bytes; half characters at the edges of a cut go too."""
    raw = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[k : k + span] for b in raw.values() for k in range(len(b) - span + 1))
    out = {}
    for i, text in docs:
        b = raw[i]
        gone = {x for k in range(len(b) - span + 1) if seen[b[k : k + span]] > 1 for x in range(k, k + span)}
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[i] = kept.decode("utf-8", "replace").replace("\ufffd", "") if gone else text
    return out


def contamination(docs: list[tuple], items: list[tuple], size: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    holders = defaultdict(set)
    for item, text in items:
        words = split(text)
        if words and item is not None:
            for k in range(max(1, len(words) - size + 1)):
                holders[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in holders}
    out = {}
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in holders:
                    hit |= set(range(k, k + n))
                    found |= holders[w]
        joined = ",".join(sorted(found)).encode()
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(joined).hexdigest(), bool(hit))
    return out


def edited_texts(docs: list[tuple]) -> dict:
    """doc_id -> (n_chars, edited_sha256, edited text, next doc_id)."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text = text or ""
        following = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (following[1] or "")[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following[0])
    return out


def token_ids(texts: list, path: str) -> list[list[int]]:
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [2] for e in found]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def bigram_scores(docs: list[tuple], target: set, weight: float = 100.0) -> dict:
    """doc_id -> (n_words, target loss, background loss, difference), over all words and pairs."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    known = {w for _, t in docs for w in split(t)}
    losses = []
    for chosen in (target, {i for i, _ in docs}):
        single, pair, context = Counter(), Counter(), Counter()
        for i, text in docs:
            if i in chosen:
                found = split(text)
                single.update(found)
                pair.update(zip([None, *found], found, strict=False))
                context.update([None, *found][: len(found)])
        total = sum(single.values()) + len(known)
        losses.append(lambda a, b, s=single, p=pair, c=context, n=total: -math.log(
            (p[a, b] + weight * (s[b] + 1) / n) / (c[a] + weight)
        ))
    out = {}
    for i, text in docs:
        found = split(text)
        t, a = (sum(loss(x, y) for x, y in zip([None, *found], found, strict=False)) / max(1, len(found)) for loss in losses)
        out[i] = (len(found), t, a, t - a)
    return out
