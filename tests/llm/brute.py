"""Brute-force versions of the operators, by their definitions and without their helpers."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import regex
import xxhash

BLANK = re.compile("[\x20\x09-\x0d]+")
MAX_ID = 2**63 - 1


def order(doc_id):
    return doc_id if doc_id is not None else MAX_ID


def exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), order(i), i))
    out = []
    for i, t in pairs:
        norm = BLANK.sub("", t or "")
        keep = min(groups[norm])[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def shingles(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(low))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def text_key(text):
    """Spark's xxhash64 of a string."""
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - 2**64 if x >= 2**63 else x


def near(pairs, percent=75):
    """For each row: (doc_id, size of its set, component, kept). Rows that have an id in common are linked."""
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = pairs[a][0] is not None and pairs[a][0] == pairs[b][0]
            if same or both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least, node = {}, {}
    for k, (i, t) in enumerate(pairs):
        least[find(k)] = min(least.get(find(k), MAX_ID), order(i))
        if sets[k]:
            node[find(k)] = min(node.get(find(k), MAX_ID), min(text_key(u) for j, (_, u) in enumerate(pairs) if sets[j] == sets[k]))
    out = []
    for k, (i, t) in enumerate(pairs):
        comp = least[find(k)] if least[find(k)] < MAX_ID else None
        kept = i == comp if i is not None else comp is None and (not sets[k] or text_key(t) == node[find(k)])
        out.append((i, len(sets[k]), comp, kept))
    return out


def covered(pairs, window=50):
    """For each row, which of its text's bytes are covered."""
    first = {}
    for i, t in sorted(pairs, key=lambda p: order(p[0])):
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], order(i))
    out = []
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < order(i):
                gone[p : p + window] = b"\1" * window
        out.append(gone)
    return out


def suffix(pairs, window=50):
    out = []
    for (i, t), gone in zip(pairs, covered(pairs, window), strict=True):
        b = (t or "").encode()
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def without_covered(pairs):
    """The texts without the characters all of whose bytes are covered; None where no byte is left."""
    out = []
    for (_, t), gone in zip(pairs, covered(pairs), strict=True):
        if all(gone):
            out.append(None)
            continue
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append("".join(kept))
    return out


def languages(docs, rows, buckets, temper=0.25, wrong=0.05, none_share=0.001, weight=20.0, least=0.5):
    """Language, probability and acceptance of each row, each by a sum over all other rows.

    docs: (text, declared language) of the labelled documents; rows: (text, declared, suffix, host).
    """

    def grams(text):
        found = Counter()
        for word in regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()):
            padded = f" {word} "
            found.update(xxhash.xxh32_intdigest(padded[k : k + 3]) % buckets for k in range(len(padded) - 2))
        return found

    names = sorted({lang.lower() for text, lang in docs if text is not None and lang is not None})
    counts = {name: Counter() for name in names}
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang.lower()].update(grams(text))
    everywhere = sum(counts.values(), Counter())
    whole = buckets + sum(everywhere.values())

    def log_of(name, bucket):
        total = sum(counts[name].values()) + 0.5 * buckets
        return math.log((counts[name][bucket] + 0.5 * buckets * (1 + everywhere[bucket]) / whole) / total)

    likely, votes = [], []
    for text, *_ in rows:
        own = grams(text)
        logs = [sum(n * log_of(name, b) for b, n in own.items()) for name in names] if own else None
        likely.append((logs, sum(own.values()) * math.log(1 / buckets)))
        votes.append(int(np.argmax(logs)) if logs else None)
    n = len(names)
    overall = [(1 + sum(v == k for v in votes)) / (n + sum(v is not None for v in votes)) for k in range(n)]
    out = []
    for at, (_, declared, suffix_, host) in enumerate(rows):
        others = [(v, r) for j, (v, r) in enumerate(zip(votes, rows, strict=True)) if j != at and v is not None]
        of_suffix = [v for v, r in others if (r[2] or "") == (suffix_ or "")]
        of_host = [v for v, r in others if ((r[2] or ""), (r[3] or "")) == ((suffix_ or ""), (host or ""))]
        said = names.index(declared.lower()) if declared is not None and declared.lower() in names else None
        logs, none = likely[at]
        scores = []
        for k in range(n):
            p = overall[k]
            if suffix_ is not None:
                p = (of_suffix.count(k) + weight * p) / (len(of_suffix) + weight)
            if host is not None:
                p = (of_host.count(k) + weight * p) / (len(of_host) + weight)
            claim = 0.0 if said is None else math.log(1 - wrong) if said == k else math.log(wrong / max(1, n - 1))
            scores.append(math.log(p * (1 - none_share)) + claim + temper * (logs[k] if logs else 0.0))
        scores.append(math.log(none_share) + (0.0 if said is None else math.log(1 / n)) + temper * (none if logs else 0.0))
        top = int(np.argmax(scores))
        probability = 1 / sum(math.exp(s - scores[top]) for s in scores)
        lang = [*names, "und"][top] if logs else "und"
        out.append((lang, probability, bool(logs) and top < n and probability >= least))
    return out


def packed(rows, want, size=1024):
    """Check pieces against the ids of each document, and that the sequences are gapless and no more than first fit gives."""
    import zlib

    bins, seen = {}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        assert r.length == size or r.piece == 0
        assert r.start == seen.get(r.doc_id, 0)
        seen[r.doc_id] = r.start + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(ids) for i, ids in want.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    first_fit = []
    for length in sorted((r.length for r in rows), reverse=True):
        at = next((k for k, used in enumerate(first_fit) if used + length <= size), None)
        if at is None:
            first_fit.append(length)
        else:
            first_fit[at] += length
    assert len(bins) <= len(first_fit)
