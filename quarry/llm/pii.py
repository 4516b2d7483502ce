"""Personal data by bootstrapped contextual extraction.

Seeds are the matches of four exact patterns (email, ip, card, phone). Tokens that look like one
of these kinds without being a match are candidates. A lexical pattern is the two words before
an occurrence, or the word before and the word after it. Spark scores the graph of patterns and
instances in rounds: a pattern by the share of trusted instances among all that it meets, an
instance by its best pattern; seeds are always trusted. Candidates whose score ends at ``ACCEPT``
or more, by patterns that met at least ``SUPPORT`` different seeds, become spans of their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, ACCEPT, SUPPORT, SMOOTH = 3, 0.7, 3, 1.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[0-9](?:[0-9 .-]*[0-9])?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
# begins at a word's begin only and never steps back, so a long word is read once
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_TRIM = ".,;:!?\"'()[]{}<>|=*#$%"
#: what a candidate of a kind has to look like
_LOOKS = {
    "email": re.compile(r"[^@\s]+(?:@|\[at\]|\(at\))[^@\s]+"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.:][0-9]{1,3}){3}(?::[0-9]+)?|(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}"),
    "card": re.compile(r"[0-9]{4}(?:[./ -]?[0-9]{3,6}){2,4}"),
    "phone": re.compile(r"(?:00[0-9]{1,3}[./-]?)?[0-9]{2,4}(?:[./-]?[0-9]{2,4}){1,4}"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; every kind in time linear in the text."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                done = m.end()
    ips, cards = [], []
    for run in _RUN.finditer(text):
        at, piece = run.start(), run.group()
        if len(piece) >= 7 and piece.count(".") >= 3:
            ips += [(1, at + m.start(), at + m.end()) for m in _IP.finditer(piece)
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        if len(piece) >= 13:
            for m in _CARD.finditer(piece):
                digits = _DIGITS.sub("", m.group())
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    cards.append((2, at + m.start(), at + m.end()))
    phones = [(3, m.start(), m.end()) for m in _PHONE.finditer(text)
              if 9 <= len(_DIGITS.sub("", m.group())) <= 15] if "+" in text else []
    return out + ips + cards + phones


def _words_around(text: str, a: int, b: int) -> list[str]:
    """The patterns of an occurrence: two words before it, and the word on either side."""
    before = text[max(0, a - 96):a].lower().split()[-2:]
    after = text[b:b + 48].lower().split()[:1]
    out = []
    if len(before) == 2:
        out.append("<" + " ".join(before))
    if before and after:
        out.append(before[-1] + "_" + after[0])
    return out


def occurrences(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """The base spans, and (kind, start, end, instance, seed, patterns) of seeds and candidates."""
    text = text or ""
    spans = base_spans(text)
    seen = [(k, a, b, text[a:b].lower(), True, _words_around(text, a, b)) for k, a, b in spans]
    held = sorted((a, b) for _, a, b in spans)
    i, reach = 0, 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        core = token.strip(_TRIM)
        a = m.start() + len(token) - len(token.lstrip(_TRIM))
        b = a + len(core)
        while i < len(held) and held[i][0] < b:
            reach = max(reach, held[i][1])
            i += 1
        if reach > a or not 5 <= len(core) <= 64:
            continue
        n = sum(c.isdigit() for c in core)
        for k, kind in enumerate(KINDS):
            if (kind == "card" and not 12 <= n <= 19) or (kind == "phone" and not 7 <= n <= 15):
                continue
            if _LOOKS[kind].fullmatch(core):
                seen.append((k, a, b, core.lower(), False, _words_around(text, a, b)))
    return spans, seen


_OCCURRENCE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()),
                         ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n_email, n_ip, n_card, n_phone, base_sha256, base, seen) of every row."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                base, seen = zip(*[occurrences(t.as_py()) for t in part.column(2)])
                count = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(_digest(x).encode()).hexdigest() for x in base])
                base = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in base], pa.list_(_SPAN))
                seen = pa.array([[dict(zip(("kind", "start", "end", "instance", "seed", "patterns"), s)) for s in x]
                                 for x in seen], pa.list_(_OCCURRENCE))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *count, sha, base, seen],
                    ["doc_id", "rid", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, {counts}, base_sha256 string, base array<struct<kind:int,start:bigint,end:bigint>>, "
                                "seen array<struct<kind:int,start:bigint,end:bigint,instance:string,seed:boolean,patterns:array<string>>>")


def trusted(seen: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(kind, instance) of the candidates that the scored graph accepts, from occurrences (kind,
    instance, seed, patterns). An instance that is a seed anywhere counts as a seed."""
    edges = (seen.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
             .groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")))
    edges = written(edges, "edges")
    # patterns that met too few seeds can never be trusted
    able = edges.groupBy("kind", "pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.count(F.lit(1)).alias("met"))
    able = written(able.where(F.col("seeds") >= support), "patterns")
    live = written(edges.join(able, ["kind", "pattern"]), "live")
    score = live.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    score = written(score, "trust")
    for _ in range(rounds):
        good = (live.join(score, ["kind", "instance"]).groupBy("kind", "pattern")
                .agg((F.sum("trust") / (F.max("met") + F.lit(SMOOTH))).alias("p")))
        best = live.join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            F.greatest(F.max(F.col("seed").cast("double")), F.max("p")).alias("trust"))
        fresh = written(best, "trust")
        drop_written(score)
        score = fresh
    known = live.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).where(~F.col("seed"))
    return score.where(F.col("trust") >= accept).join(known, ["kind", "instance"]).select("kind", "instance")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Offsets are code points, ends exclusive; spans are ordered by kind (email, ip, card, phone), then
    start. Base spans always stay; added spans overlap none of them. A null text is empty; repeated
    rows are each returned; other columns don't matter; no rows give no rows.
    """
    rows = written(find(docs), "found")
    seen = rows.select("rid", F.explode("seen").alias("s")).select("rid", "s.*")
    accepted = trusted(seen)
    added = seen.where(~F.col("seed")).join(accepted, ["kind", "instance"]).groupBy("rid").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    out = rows.drop("seen").join(added, "rid", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    every = F.array_sort(F.concat("base", F.coalesce("added", none)))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(text, ",").alias("spans"),
                      F.size(F.coalesce("added", none)).cast("long").alias("n_added"))
