"""License detection by ordered signature rules; DataFrame operations only.

A rule is a regular expression with a label, a priority and a keyword without which it can't
match ("a|b": one of them must occur). A text is tested against a rule only if it holds the rule's keyword. Of the matches in a
text, one is suppressed if it lies inside another of the same or a stronger priority (equal
spans: the stronger, then the earlier rule stays).
"""

from __future__ import annotations

import string
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER_WORD, written

#: fixed values of the contract: phrase, label
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Rule(NamedTuple):
    rule: str
    label: str
    priority: int  # 0 is the strongest
    keyword: str
    pattern: str
    confidence: float


#: label: (regular expression of the name, keyword in every such name, SPDX ids, regular expression of the abbreviation)
FAMILIES: dict[str, tuple[str, str, str, str | None]] = {
    "gpl": (r"gnu\W+general\W+public\W+licen[cs]e", "general", r"gpl-[123]\.0", r"(?:gnu\W+)?gpl"),
    "lgpl": (r"(?:gnu\W+)?(?:lesser|library)\W+general\W+public\W+licen[cs]e", "general", r"lgpl-[23]\.[01]", r"lgpl"),
    "agpl": (r"(?:gnu\W+)?affero\W+general\W+public\W+licen[cs]e", "affero", r"agpl-[13]\.0", r"agpl"),
    "gfdl": (r"gnu\W+free\W+documentation\W+licen[cs]e", "documentation", r"gfdl-1\.[123]", r"gfdl"),
    "apache": (r"apache\W+(?:software\W+)?licen[cs]e", "apache", r"apache-[12]\.[01]", None),
    "mit": (r"(?:the\W+)?(?:mit|expat)\W+licen[cs]e", "licen", r"mit(?:-0)?", None),
    "x11": (r"x11\W+licen[cs]e", "x11", r"x11", None),
    "bsd": (r"(?:new\W+|modified\W+|simplified\W+|original\W+|free)?bsd\W+(?:style\W+)?licen[cs]e", "bsd", r"[0234]?-?bsd(?:-[234]-clause)?", None),
    "bsd-2-clause": (r"(?:2|two)\W?clause\W+bsd", "clause", r"bsd-2-clause", r"bsd\W?2\W?clause"),
    "bsd-3-clause": (r"(?:3|three)\W?clause\W+bsd", "clause", r"bsd-3-clause", r"bsd\W?3\W?clause"),
    "bsd-4-clause": (r"(?:4|four)\W?clause\W+bsd", "clause", r"bsd-4-clause", r"bsd\W?4\W?clause"),
    "isc": (r"(?:the\W+)?isc\W+licen[cs]e", "isc", r"isc", None),
    "zlib": (r"(?:the\W+)?zlib(?:\W+libpng)?\W+licen[cs]e", "zlib", r"zlib", None),
    "libpng": (r"libpng\W+licen[cs]e", "libpng", r"libpng(?:-2\.0)?", None),
    "boost": (r"boost\W+software\W+licen[cs]e", "boost", r"bsl-1\.0", None),
    "mpl": (r"mozilla\W+public\W+licen[cs]e", "mozilla", r"mpl-[12]\.[01]", r"mpl\W?[12]\.[01]"),
    "epl": (r"eclipse\W+public\W+licen[cs]e", "eclipse", r"epl-[12]\.0", r"epl\W?[12]\.0"),
    "edl": (r"eclipse\W+distribution\W+licen[cs]e", "eclipse", r"edl-1\.0", None),
    "cpl": (r"common\W+public\W+licen[cs]e", "common", r"cpl-1\.0", None),
    "cddl": (r"common\W+development\W+and\W+distribution\W+licen[cs]e", "common", r"cddl-1\.[01]", r"cddl"),
    "cpal": (r"common\W+public\W+attribution\W+licen[cs]e", "attribution", r"cpal-1\.0", None),
    "ibm-public": (r"ibm\W+public\W+licen[cs]e", "ibm", r"ipl-1\.0", None),
    "eupl": (r"european\W+union\W+public\W+licen[cs]e", "european", r"eupl-1\.[012]", r"eupl"),
    "artistic": (r"(?:perl\W+)?artistic\W+licen[cs]e", "artistic", r"artistic-[12]\.0", None),
    "ofl": (r"(?:sil\W+)?open\W+font\W+licen[cs]e", "font", r"ofl-1\.[01]", None),
    "openssl": (r"openssl\W+licen[cs]e", "openssl", r"openssl", None),
    "php": (r"php\W+licen[cs]e", "php", r"php-3\.0[01]?", None),
    "psf": (r"(?:python\W+software\W+foundation|psf|python)\W+licen[cs]e", "licen", r"psf-2\.0|python-2\.0", None),
    "ruby": (r"ruby\W+licen[cs]e", "ruby", r"ruby", None),
    "postgresql": (r"postgresql\W+licen[cs]e", "postgresql", r"postgresql", None),
    "ncsa": (r"(?:university\W+of\W+illinois\W+)?ncsa\W+(?:open\W+source\W+)?licen[cs]e", "ncsa", r"ncsa", None),
    "ms-pl": (r"microsoft\W+public\W+licen[cs]e", "microsoft", r"ms-pl", None),
    "ms-rl": (r"microsoft\W+reciprocal\W+licen[cs]e", "microsoft", r"ms-rl", None),
    "afl": (r"academic\W+free\W+licen[cs]e", "academic", r"afl-[123]\.[01]", None),
    "osl": (r"open\W+software\W+licen[cs]e", "software", r"osl-[123]\.[01]", None),
    "ecl": (r"educational\W+community\W+licen[cs]e", "educational", r"ecl-[12]\.0", None),
    "qpl": (r"q\W+public\W+licen[cs]e", "public", r"qpl-1\.0", None),
    "sleepycat": (r"sleepycat\W+licen[cs]e", "sleepycat", r"sleepycat", None),
    "vim": (r"vim\W+licen[cs]e", "vim", r"vim", None),
    "wtfpl": (r"do\W+what\W+the\W+fuck\W+you\W+want\W+to\W+public\W+licen[cs]e", "public", r"wtfpl", r"wtfpl"),
    "unlicense": (r"the\W+unlicen[cs]e", "unlicen", r"unlicense", None),
    "odbl": (r"open\W+(?:data\W+commons\W+open\W+)?database\W+licen[cs]e", "database", r"odbl-1\.0", r"odbl"),
    "odc-by": (r"open\W+data\W+commons\W+attribution\W+licen[cs]e", "commons", r"odc-by-1\.0", None),
    "pddl": (r"public\W+domain\W+dedication\W+and\W+licen[cs]e", "dedication", r"pddl-1\.0", r"pddl"),
    "nasa": (r"nasa\W+open\W+source\W+agreement", "nasa", r"nasa-1\.3", None),
    "w3c": (r"w3c\W+(?:software\W+)?(?:notice\W+and\W+)?licen[cs]e", "w3c", r"w3c", None),
    "unicode": (r"unicode\W+(?:terms\W+of\W+use|licen[cs]e)", "unicode", r"unicode-(?:dfs-2016|3\.0)", None),
    "cc0": (r"(?:creative\W+commons|cc)\W+zero", "zero", r"cc0-1\.0", r"cc0(?:\W?1\.0)?"),
    "public-domain": (r"(?:dedicated\W+to|released\W+in(?:to)?|in)\W+the\W+public\W+domain", "domain", r"(?:licenseref-)?public-domain", None),
    "proprietary": (r"all\W+rights\W+reserved", "reserved", r"licenseref-proprietary", None),
    "confidential": (r"(?:proprietary|confidential)\W+and\W+(?:proprietary|confidential)", "confidential|proprietary", r"licenseref-confidential", None),
}
#: Creative Commons: label, the words after "by"
CC_TERMS = {
    "cc-by": ("", ""),
    "cc-by-sa": ("sa", r"\W+share\W?alike"),
    "cc-by-nc": ("nc", r"\W+non\W?commercial"),
    "cc-by-nd": ("nd", r"\W+no\W?deriv(?:ative)?s?"),
    "cc-by-nc-sa": (r"nc\W+sa", r"\W+non\W?commercial\W+share\W?alike"),
    "cc-by-nc-nd": (r"nc\W+nd", r"\W+non\W?commercial\W+no\W?deriv(?:ative)?s?"),
}
#: fixed values: sentences of the license texts themselves and of the notices they ask for: (label, rule, priority,
#: keyword, the words, confidence); any non-word characters may stand between words
TEXTS = [
    ("mit", "body", 0, "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("boost", "body", 0, "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy", 0.95),
    ("isc", "body", 0, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "body-and", 0, "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("postgresql", "body", 0, "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", 0.9),
    ("bsd", "body", 1, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-4-clause", "body", 0, "advertising", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("zlib", "body", 0, "misrepresented", "the origin of this software must not be misrepresented", 0.9),
    ("unlicense", "body", 0, "unencumbered", "this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "body", 0, "fuck", "you just do what the fuck you want to", 0.9),
    ("cc0", "body", 0, "extent", "to the extent possible under law", 0.6),
    ("ncsa", "body", 0, "restriction", "to deal with the software without restriction", 0.7),
    ("apache", "notice", 0, "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("mpl", "notice", 0, "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("gpl", "notice", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "notice", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    ("lgpl", "notice-library", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu library general public license", 1.0),
    ("agpl", "notice", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    ("gfdl", "notice", 0, "documentation", "distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("proprietary", "notice", 1, "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 0.9),
]
#: fixed values: the clause that makes three clauses of BSD's two; holders' names stand in the gap
BSD_NAMES = r"neither\W+the\W+names?\W+of\W+(?:\w+\W+){1,12}?nor\W+the\W+names\W+of\W+(?:its|their|the|other)\W+contributors"
#: fixed values: label, keyword, address below which the license's own text lies
HOMES = [
    ("apache", "apache.org", r"apache\.org/licenses/license-[12]\.[01]"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses/(?:old-licenses/)?|copyleft/)gpl"),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses/(?:old-licenses/)?|copyleft/)(?:lgpl|lesser)"),
    ("agpl", "gnu.org", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses/(?:old-licenses/)?|copyleft/)fdl"),
    ("mpl", "mozilla.org", r"mozilla\.org/(?:[a-z-]+/)?mpl"),
    ("epl", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl"),
    ("boost", "boost.org", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("ofl", "sil.org", r"scripts\.sil\.org/ofl"),
    ("php", "php.net", r"php\.net/license"),
    ("cc0", "creativecommons", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "creativecommons", r"creativecommons\.org/publicdomain/mark"),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
]
CC_GATE = r"(?<![0-9a-z\u0080-\x{10FFFF}])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by(?![0-9a-z\u0080-\x{10FFFF}])"
#: "cc by" as the rules see it: any non-word characters between
CC_RULE_GATE = r"(?<![0-9a-z])cc\W+by(?![0-9a-z])"
EDGE, END = r"(?<![0-9a-z])", r"(?![0-9a-z])"
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|governed)\W+(?:under|by|according\W+to)\W+(?:\w+\W+){0,4}?"
VERSION = r"\W{1,3}(?:version\W{1,3}|v\W?)?[0-9](?:\.[0-9])?"


def rules() -> list[Rule]:
    """Every family's forms: SPDX tag and URL (0), grant with and without version (0, 1), name with
    version and alone (1, 2), abbreviation (3); sentences of license texts and notices, the addresses of
    the texts (0, 1)."""
    out = []
    for label, (name, keyword, spdx, short) in FAMILIES.items():
        out += [
            Rule(f"{label}:spdx", label, 0, "spdx", rf"spdx\W?license\W?identifier\W+(?:{spdx})(?:-only|-or-later|\+)?{END}", 1.0),
            Rule(f"{label}:url", label, 0, "opensource.org", rf"opensource\.org/licenses?/(?:{spdx})(?:\.php|\.html)?{END}", 0.95),
            Rule(f"{label}:grant-version", label, 0, keyword, rf"{EDGE}{GRANT}(?:{name}){VERSION}{END}", 0.99),
            Rule(f"{label}:grant", label, 1, keyword, rf"{EDGE}{GRANT}(?:{name}){END}", 0.95),
            Rule(f"{label}:version", label, 1, keyword, rf"{EDGE}(?:{name}){VERSION}{END}", 0.9),
            Rule(f"{label}:name", label, 2, keyword, rf"{EDGE}(?:{name}){END}", 0.8),
        ]
        if short:
            key = next(g for g in ("lgpl", "agpl", "gpl", "gfdl", "cddl", "eupl", "wtfpl", "odbl", "pddl", "cc0", "mpl", "epl", "bsd") if g in short)
            out.append(Rule(f"{label}:short", label, 3, key, rf"{EDGE}(?:{short}){END}", 0.5))
    for label, (code, words) in CC_TERMS.items():
        tail = rf"\W+{code}" if code else ""
        no_more = END if "nd" in code or "sa" in code else END + r"(?!\W+(?:sa|nd|nc)\b)"
        out += [
            Rule(f"{label}:version", label, 1, "cc", rf"{EDGE}cc\W+by{tail}\W+[1-4]\.[05]{END}", 0.95),
            Rule(f"{label}:code", label, 2, "cc", rf"{EDGE}cc\W+by{tail}{no_more}", 0.8),
            Rule(f"{label}:words", label, 1, "attribution", rf"creative\W+commons\W+attribution{words}(?:\W+[1-4]\.[05])?{END}", 0.9),
            Rule(f"{label}:url", label, 0, "creativecommons", rf"creativecommons\.org/licenses/{label[3:]}/[1-4]\.[05]", 1.0),
        ]
    for label, name, priority, keyword, words, confidence in TEXTS:
        out.append(Rule(f"{label}:{name}", label, priority, keyword, EDGE + r"\W+".join(words.split()) + END, confidence))
    out.append(Rule("bsd-3-clause:body", "bsd-3-clause", 0, "contributors", EDGE + BSD_NAMES + END, 0.95))
    out += [Rule(f"{label}:home", label, 0, keyword, EDGE + address + END, 0.95) for label, keyword, address in HOMES]
    return out


def gates() -> list[str]:
    """Single words without any of which a text holds no rule's match, besides "cc by" (CC_GATE, CC_RULE_GATE):
    "licen" for families whose name ends in license, else the rules' keywords."""
    ends = {label for label, (name, *_) in FAMILIES.items() if name.endswith("licen[cs]e")}
    words = set()
    for r in rules():
        named = r.rule.rsplit(":", 1)[1] in ("grant-version", "grant", "version", "name")
        if r.label in ends and named:
            words.add("licen")
        elif r.keyword != "cc":
            words.update(r.keyword.split("|"))
    return sorted(words)


def _letters_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found) of every
    row. Null, empty and wordless texts have no words and labels ''; repeated rows are each
    returned; other columns don't matter; no rows give no rows.
    """
    low = _letters_lower(F.coalesce("text", F.lit("")))
    gated = F.col("low").rlike(f"{CC_GATE}|{CC_RULE_GATE}")
    for g in gates():
        gated = F.col("low").contains(g) | gated
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), low.alias("low"))
    rows = written(rows.select("doc_id", "rid", F.regexp_count("low", F.lit(LETTER_WORD)).cast("long").alias("n_words"),
                               F.when(gated, F.col("low")).alias("low")), "gated")
    held = rows.where("low IS NOT NULL")
    found = _kept(_spans(held.select("rid", "low"))).groupBy("rid").agg(
        F.collect_set("label").alias("more"), F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n_found"))
    out = rows.drop("low").join(_base(held), "rid", "left").join(found, "rid", "left")
    base = F.coalesce("base", F.array().cast("array<string>"))
    every = F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))
    floor = F.when(F.size(base) > 0, 0.5).otherwise(0.0)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(every), ",").alias("labels"),
        F.greatest(floor, F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def _base(held: DataFrame) -> DataFrame:
    """rid, n_base, first_word, last_word, base (labels) of rows with a base phrase: the words are put
    a space apart; what lies before the first and after the last place gives their word numbers."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    phrase = F.lit("(?<= )(?:" + "|".join(BASE_PHRASES) + ")(?= )")
    at = held.select("rid", "n_words", plain.alias("plain")).where(F.regexp("plain", phrase))
    at = at.select("rid", "n_words", F.split("plain", phrase, -1).alias("parts"),
                   F.regexp_extract_all("plain", phrase, F.lit(0)).alias("hits"))
    count = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    labels = F.create_map(*[F.lit(x) for pair in BASE_PHRASES.items() for x in pair])
    return at.select(
        "rid", F.size("hits").alias("n_base"), count(F.element_at("parts", 1)).alias("first_word"),
        (F.col("n_words") - count(F.element_at("parts", -1)) - count(F.element_at("hits", -1))).alias("last_word"),
        F.transform(F.array_distinct("hits"), lambda h: labels[h]).alias("base"))


def _spans(held: DataFrame) -> DataFrame:
    """(rid, rule, label, priority, confidence, start, end) of every match of every rule."""
    table = rules()
    spark = held.sparkSession
    known = spark.createDataFrame([tuple(r) for r in table], "rule string, label string, priority int, keyword string, pattern string, confidence double")
    words = sorted({r.keyword for r in table})
    holds = lambda w: reduce(Column.__or__, [F.col("low").contains(x) for x in w.split("|")])
    has = F.array_compact(F.array(*[F.when(holds(w), F.lit(w)) for w in words]))
    tested = held.withColumn("keyword", F.explode(has)).join(F.broadcast(known), "keyword")  # the rules: a fixed list
    tested = tested.where(F.expr("low RLIKE pattern"))
    pieces = tested.select(
        "rid", "rule", "label", "priority", "confidence",
        F.posexplode(F.arrays_zip(F.split("low", F.col("pattern"), -1).alias("part"),
                                  F.regexp_extract_all("low", F.col("pattern"), F.lit(0)).alias("hit"))).alias("pos", "x"))
    pieces = pieces.select("rid", "rule", "label", "priority", "confidence", "pos", F.length("x.part").cast("long").alias("gap"),
                           F.length("x.hit").cast("long").alias("long")).repartition("rid")
    so_far = Window.partitionBy("rid", "rule").orderBy("pos")
    end = F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(so_far)
    return pieces.withColumn("end", end).where("long IS NOT NULL").withColumn("start", F.col("end") - F.col("long")).drop("gap", "long", "pos")


def _kept(spans: DataFrame) -> DataFrame:
    """The spans inside no other of the same or a stronger priority: in order of start (longer first),
    an earlier span that ends no sooner holds this one."""
    earlier = Window.partitionBy("rid").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    holds = F.lit(False)
    for p in range(4):
        reach = F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier)
        holds = holds | ((F.col("priority") == p) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    return spans.withColumn("held", holds).where(~F.col("held")).drop("held")
