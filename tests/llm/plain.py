"""Plain versions of the operators, and the odd documents that all tests share."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import ceil, floor

import xxhash
from pyspark.sql import types as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")

#: documents with extra columns whose names the operators use themselves
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
    T.StructField("shard", T.LongType()), T.StructField("rank", T.StringType()), T.StructField("word", T.MapType(T.StringType(), T.LongType())),
])


def row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, len(text or ""), "x", 9, None, {"k": 1}


def odd_rows():
    long = " ".join(f"w{i % 977}x" for i in range(30_000))
    return [
        row(1, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "Two words"), row(6, long), row(7, "a" * 50_000),
        row(8, "the same text again here"), row(9, "the same text again here"), row(9, "the same text again here"),
        row(10, "THE same text again HERE", source=None), row(None, "no id at all here"), row(None, None, None, None),
        row(11, "Grüße aus Zürich, naïve café — 日本語 текст", "de", "b"), row(12, "%%% ### !!!", None, "b"),
    ]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def letter_words(text):
    return LETTERS.findall((text or "").translate(LOW))


def fingerprint(text, width=3):
    words = SPACED.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=3):
    """(doc_id, fingerprint) rows -> smallest doc_id reachable, in the order of the rows."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for d, f in rows:
        r = find(f)
        if d is not None and (low[r] is None or d < low[r]):
            low[r] = d
    return [low[find(f)] for _, f in rows]


def contamination(text, items, width=10):
    """n_words, n_hit, n_items, sha256 of the items with windows in the text."""
    words = letter_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = letter_words(body)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            w = own[i:i + width]
            for p in range(len(words) - len(w) + 1):
                if words[p:p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def draw(*parts):
    h = hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:12]
    return (int(h, 16) + 0.5) / (1 << 48)


def shards(rows, shards=8):
    """(doc_id, source) rows without repeated ids -> doc_id: (shard, slot)."""
    by = defaultdict(list)
    for d, s in rows:
        by[s].append((draw("shard", d), d is None, d))
    placed = []
    for s, own in by.items():
        for r, (u, none, d) in enumerate(sorted(own, key=lambda x: (x[0], x[1], x[2] or 0))):
            placed.append(((r + 0.5) / len(own), u, s is None, s or "", none, d or 0, d))
    out, n = {}, len(rows)
    for at, p in enumerate(sorted(placed, key=lambda x: x[:6])):
        k = floor(at * shards / n)
        out[p[6]] = (k, at - ceil(k * n / shards))
    return out


def mix_targets(sizes):
    """source -> (size, target): share by weight, stop at three times the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: (sizes[s], 3.0 * sizes[s] if s in stopped else share[s]) for s in names}
        stopped |= over


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    words, at, labels = letter_words(text), [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base_score(text, counts):
    from math import log10
    words = SPACED.findall((text or "").translate(LOW)) + [None]
    n, v = sum(counts.values()), len(counts)
    return len(words), sum(counts[w] > 0 for w in words), sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


def word_counts(texts):
    out = Counter()
    for t in texts:
        out.update(SPACED.findall((t or "").translate(LOW)) + [None])
    return out
