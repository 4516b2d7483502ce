"""The document operators against plain versions: on the smallest tables, on odd rows, on no rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, language_id, license_scan, mixing, pii, queries, sharding, simhash, toxicity

from . import plain
from .conftest import SMOKE


def by_row(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


# ---- SimHash


def test_masks_cover_every_small_difference():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15 and all(24 <= m.bit_count() <= 40 for m in masks)
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(m & d == 0 for m in masks)


def test_fingerprints_and_components(spark, smoke):
    got = queries.op1_simhash(spark, SMOKE).collect()
    rows = [(r.doc_id, plain.fingerprint(r.text)) for r in smoke]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(rows, plain.components(rows))]
    assert by_row(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_simhash_odd_rows(spark):
    rows = plain.odd_rows()
    got = simhash.simhash_components(plain.frame(spark, rows)).collect()
    pairs = [(r[0], plain.fingerprint(r[1])) for r in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(pairs, plain.components(pairs))]
    assert by_row(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.simhash_components(plain.frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_dense_groups(spark, block):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 3, block)
    roots = {r.node % (1 << 64): r.root for r in simhash.connected_components(links).collect()}
    want = plain.components([(f, f) for f in sorted(fps)])
    groups = lambda key: sorted(sorted(f for f in fps if key(f) == k) for k in {key(f) for f in fps})
    low = dict(zip(sorted(fps), want))
    assert groups(lambda f: roots.get(f, f)) == groups(low.get)


def test_keep_one(spark):
    rows = plain.odd_rows()
    docs = plain.frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # 1 stands for all wordless texts and 8 for the copies; what has no id stays if its group has none
    assert by_row(kept.collect(), "doc_id") == by_row(spark.createDataFrame(
        [(x,) for x in (1, 4, 5, 6, 7, 8, 11, 12, None)], "doc_id long").collect(), "doc_id")
    assert simhash.keep_one(plain.frame(spark, [])).count() == 0


# ---- decontamination


def test_decontamination_matches_plain(spark, smoke):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.op10_decontamination(spark, SMOKE).collect()}
    assert sum(r.contaminated for r in got.values()) > 0
    for r in smoke:
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == plain.contamination(r.text, items)


def test_decontamination_odd_rows(spark):
    items = [(1, "one"), (2, None), (3, ""), (4, "again here"), (4, "TEXT, again"), ("x", "w1x w2x w3x w4x w5x w6x w7x w8x w9x w10x w11x"), (None, "no id")]
    bench = spark.createDataFrame([(None if i is None else str(i), t, 5) for i, t in items], "item_id string, text string, n_words int")
    rows = plain.odd_rows()
    named = [("" if i is None else i, t) for i, t in items]
    for size in (1, 1 << 20):
        got = decontaminate.decontaminate(plain.frame(spark, rows), bench, slop=1, segment_bytes=size).collect()
        want = [(r[0], *plain.contamination(r[1], named)) for r in rows]
        assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == sorted(want, key=repr)
    assert decontaminate.decontaminate(plain.frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(plain.frame(spark, []), bench).count() == 0
    kept = decontaminate.drop_contaminated(plain.frame(spark, rows), bench)
    assert kept.columns == list(plain.SCHEMA.names)
    assert by_row(kept.collect(), "doc_id") == sorted([(r[0],) for r, w in zip(rows, want) if not w[2]], key=repr)


def test_full_index_blocks_and_proximity(spark, monkeypatch):
    rows = [plain.row(1, "alpha beta x gamma delta"), plain.row(2, "alpha beta gamma delta"), plain.row(3, "delta gamma beta alpha")]
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "gamma delta"), (3, "beta x")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)  # a block for each item, and every term indexed
    got = {r.doc_id: r for r in decontaminate.decontaminate(plain.frame(spark, rows), bench).collect()}
    assert [(got[d].n_hit, got[d].n_items) for d in (1, 2, 3)] == [(4, 2), (4, 2), (0, 0)]
    assert got[1].n_near_items == 3 and got[2].n_near_items >= 2


# ---- sharding, mixing


def test_shards(spark, smoke):
    got = queries.op6_sharding(spark, SMOKE).collect()
    want = plain.shards([(r.doc_id, r.source) for r in smoke])
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    import zlib
    texts = {r.doc_id: (r.text or "").encode() for r in smoke}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)


def test_shards_odd_rows(spark):
    for rows in (plain.odd_rows(), plain.odd_rows() * 5, [plain.row(1, "x")] * 50, []):
        got = queries.sharded(plain.frame(spark, rows)).collect()
        assert len(got) == len(rows)
        slots = [sorted(r.slot for r in got if r.shard == k) for k in range(sharding.SHARDS)]
        assert all(s == list(range(len(s))) for s in slots)
        assert max(map(len, slots)) - min(map(len, slots)) <= 1
        assert by_row(got, "doc_id") == sorted([(r[0],) for r in rows], key=repr)


def test_shards_match_the_mixture(spark):
    rows = [plain.row(i, "x", source="hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    got = queries.sharded(plain.frame(spark, rows)).collect()
    for s in {r.source for r in got}:
        counts = [sum(r.source == s and r.shard == k for r in got) for k in range(8)]
        assert max(counts) - min(counts) <= 1 + len({r.source for r in got})


def _mix(spark, rows):
    docs = plain.frame(spark, rows).select(F.lit(0).alias("key"), "doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).collect()


def test_mix_targets_and_sizes(spark, smoke):
    got = queries.op8_mixing(spark, SMOKE).collect()
    words = {r.doc_id: len(plain.SPACED.findall(r.text or "")) for r in smoke}
    sizes = {}
    for r in smoke:
        sizes[r.source] = sizes.get(r.source, 0) + words[r.doc_id]
    want = plain.mix_targets(sizes)
    for r in got:
        assert r.size == words[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.source_size == want[r.source][0] and r.target == pytest.approx(want[r.source][1], rel=1e-12)
    for s, (_, target) in want.items():
        longest = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= longest


def test_mix_odd_rows(spark):
    rows = plain.odd_rows() + [plain.row(i, "w " * (i % 50), source=f"s{i % 4}") for i in range(20, 400)] + [plain.row(777, "rep eated", source="s1")] * 40
    got = _mix(spark, rows)
    assert by_row(got, "doc_id") == sorted([(r[0],) for r in rows], key=repr)
    assert by_row(got, "doc_id", "size", "taken") == by_row(_mix(spark, rows[::-1]), "doc_id", "size", "taken")
    want = plain.mix_targets({s: sum(len(plain.SPACED.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    for s, (_, target) in want.items():
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - target) <= max(r.size for r in got if r.source == s)
    assert _mix(spark, []) == []
    assert _mix(spark, [plain.row(1, None), plain.row(2, "", source=None)])[0].taken == 0


def test_mix_passes_over_documents_that_do_not_fit(spark):
    """One document of 6,000 words and 4,000 of one word, 2,500 words to draw beside two whole copies; and
    every source ends within half the shortest document that still fits."""
    rng = random.Random(8)
    rows = [plain.row(0, "w " * 6000, source="a")] + [plain.row(i, "w", source="a") for i in range(1, 4001)]
    rows += [plain.row(10_000 + i, "w " * rng.choice([3, 7, 8, 60, 400, 2000]), source="b") for i in range(60)]
    rows += [plain.row(20_000 + i, "w " * 5000, source="c") for i in range(3)]
    rows += [plain.row(30_000 + i, "w " * rng.randint(1, 900), source="d") for i in range(300)]
    rows += [plain.row(None, "w " * 11, source=None)] * 9
    by_source = {}
    for r in _mix(spark, rows):
        by_source.setdefault(r.source, []).append(r)
    assert abs(sum(r.taken for r in by_source["a"]) - by_source["a"][0].target) < 1
    for source, got in by_source.items():
        total, target = got[0].source_size, got[0].target
        whole = target // total if total else 0
        assert all(whole <= r.copies <= whole + 1 <= 4 and r.copies <= 3 for r in got)
        off = target - sum(r.taken for r in got)
        left = [r.size for r in got if r.copies == whole and 0 < r.size <= off]
        assert not left or abs(off) <= min(left) / 2, (source, off, min(left))
        assert off >= -max(r.size for r in got) / 2


def test_row_ids_tell_nulls_and_neighbours_apart(spark):
    schema = "doc_id long, text string, lang string, source string, _llm_row string, _copies string, copies long, rows binary, m map<string,string>"
    rows = [(1, "t", "x", None, None, "a", 5, b"\xff", {"k": None}), (1, "t", None, None, "x", "a", 5, b"\xff", {"k": None}),
            (1, "t", "x", None, "a", None, 5, b"\xff", {"k": None}), (1, "t", "x", None, None, "a", 5, b"\xfe", {"k": None}),
            (1, "t", "x", None, None, "a", 5, b"\xff", {"j": None}), (1, "t", "x", None, None, "a", 5, b"\xff", None),
            (2, "ab", "c", None, None, None, None, None, None), (2, "a", "bc", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    assert docs.select(common.row_id(docs)).distinct().count() == len(rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    # one source, so its target is its size: every row once
    assert mixed.count() == len(rows) and mixed.select(common.row_id(mixed)).distinct().count() == len(rows)
    far = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "ab")], "item_id long, text string"))
    assert far.columns == docs.columns and far.count() == len(rows) - 1
    assert simhash.keep_one(docs).count() == 3


def test_mixed_rows(spark):
    rows = plain.odd_rows()
    docs = plain.frame(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("doc_id = 6").count() <= 3
    assert mixing.mixed(plain.frame(spark, [])).count() == 0


def test_pareto_ranks_favour_long_documents(spark):
    rows = [plain.row(i, "w " * (40 if i % 2 else 10), source="a") for i in range(400)] + [plain.row(1000 + i, "w " * 50, source="b") for i in range(400)]
    got = [r for r in _mix(spark, rows) if r.source == "b"]
    assert 0 < sum(r.copies for r in got) < 400


# ---- personal data


def test_base_spans_match_plain(spark, smoke):
    got = {r.doc_id: r for r in queries.op3_pii(spark, SMOKE).collect()}
    import hashlib
    for r in smoke:
        want = plain.base_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_on_random_text(seed):
    rng = random.Random(seed)
    pieces = ["a@b.c", "@", ".", "+1", "-", " ", "(", ")", "1.2.3.4", "255", "256.1.1.1", "4111 1111 1111 1111", "9", "x", "é", "%", "\n", "00", "+49 30 1234567"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain.base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1.1" * 100_000, "+" * 300_000, "1 " * 200_000):
        pii.occurrences(text)


def test_patterns_discover_unseen_identifiers(spark):
    cues = [plain.row(i, f"please call me +1 555 010 {1000 + i} today or mail me") for i in range(8)]
    hidden = [plain.row(100 + i, f"please call me 555-01{i}-7788 today") for i in range(3)]
    elsewhere = [plain.row(200, "some order 555-010-7788 was shipped"), plain.row(201, "version 123-4567-89 of it")]
    got = {r.doc_id: r for r in pii.personal_data(plain.frame(spark, cues + hidden + elsewhere)).collect()}
    assert [got[100 + i].spans for i in range(3)] == ["phone:15:27"] * 3
    assert got[200].n_added == 1 and got[201].n_added == 0  # the same number is known anywhere
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(8))


def test_pii_odd_rows(spark):
    rows = plain.odd_rows()
    got = pii.personal_data(plain.frame(spark, rows))
    assert by_row(got.collect(), "doc_id") == sorted([(r[0],) for r in rows], key=repr)
    assert pii.personal_data(plain.frame(spark, [])).count() == 0


# ---- language


def test_language_of_held_out_documents(spark, smoke):
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SMOKE).collect()}
    held = [r for r in smoke if got[r.doc_id].held_out]
    import zlib
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in smoke)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    rows = plain.odd_rows()
    docs = plain.frame(spark, rows)
    known = language_id.profiles(docs)
    got = language_id.identify(docs, known).collect()
    assert by_row(got, "doc_id") == sorted([(r[0],) for r in rows], key=repr)
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 12} <= none and 4 not in none
    assert all(r.lang_pred == "und" and r.score == 0 for r in language_id.identify(docs, {}).collect())
    assert language_id.identify(plain.frame(spark, []), known).count() == 0 and language_id.profiles(plain.frame(spark, [])) == {}


def test_grams_of_many_scripts_are_products():
    space = language_id._Space(64)
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300))
    for t in ("abc abd", text, "abc " + text):
        n = space.letter_numbers(t)
        rows = space.grams(n)
        import numpy as np
        for i in (0, len(rows) - 1):
            x, y, z = (space.letters[k] for k in n[i:i + 3])
            assert (space.table[rows[i]] == np.roll(x, 2) * np.roll(y, 1) * z).all()


# ---- licenses


def test_license_base_matches_plain(spark, smoke):
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, SMOKE).collect()}
    for r in smoke:
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == plain.license_base(r.text)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_license_rules(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "This is CC BY-NC 4.0 and MIT-License stuff; mit license",
        3: "SPDX-License-Identifier: GPL-3.0-or-later", 4: "GNU Lesser General Public License v2.1", 5: "no licence here",
        6: "Redistributed under the terms of the Mozilla Public License 2.0 and the BSD 3-clause", 7: "wacc by", 8: "GNU General Public License",
        9: "https://opensource.org/licenses/MIT and creativecommons.org/licenses/by-sa/4.0",
    }
    got = {r.doc_id: r for r in license_scan.scan(plain.frame(spark, [plain.row(k, v) for k, v in texts.items()])).collect()}
    want = {1: "apache", 2: "cc-by,cc-by-nc,mit", 3: "gpl", 4: "lgpl", 5: "", 6: "bsd-3-clause,mpl", 7: "", 8: "gpl", 9: "cc-by-sa,mit"}
    assert {k: r.labels for k, r in got.items()} == want
    for k, v in texts.items():
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == plain.license_base(v)
    assert len(license_scan.rules()) > 200


LICENSE_TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated files",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used",
    "bsd-4-clause": "3. All advertising materials mentioning features or use of this software must display the following",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,",
    "zlib": "1. The origin of this software must not be misrepresented; you must not claim",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "apache": "# you may not use this file except in compliance with the License.\n# http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
    "lgpl": "see https://www.gnu.org/licenses/lgpl-3.0.html", "agpl": "https://www.gnu.org/licenses/agpl-3.0", "cc0": "creativecommons.org/publicdomain/zero/1.0/",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.", "boost": "http://www.boost.org/LICENSE_1_0.txt",
}


def test_license_texts_and_addresses(spark):
    clean = ["permission to enter was granted free of charge", "redistribution of wealth in binary terms", "neither the name nor the rest", "compliance"]
    long = "word " * 200_000 + LICENSE_TEXTS["mit"] + " word" * 200_000
    rows = [*LICENSE_TEXTS.values(), *clean, long]
    got = {r.doc_id: r for r in license_scan.scan(plain.frame(spark, [plain.row(i, t) for i, t in enumerate(rows)])).collect()}
    for i, label in enumerate([*LICENSE_TEXTS, *[""] * len(clean), "mit"]):
        assert got[i].labels == label and (got[i].score >= 0.9 if label else got[i].score == 0), rows[i][:80]


def plain_license(text, rules):
    """(labels, confidence, found) of every rule's matches that lie in no other of the same or a stronger priority."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    spans = [(m.start(), m.end(), r) for r, pattern in rules if any(k in low for k in r.keyword.split("|")) for m in pattern.finditer(low)]
    order = sorted(spans, key=lambda s: (s[0], -s[1], s[2].priority, s[2].rule))
    kept = [s for i, s in enumerate(order) if not any(o[1] >= s[1] and o[2].priority <= s[2].priority for o in order[:i])]
    return {s[2].label for s in kept}, max((s[2].confidence for s in kept), default=0.0), len(kept)


def test_license_labels_match_brute_force(spark, smoke):
    assert all(keyword in words.split() for _, _, _, keyword, words, _ in license_scan.TEXTS)
    rules = [(r, re.compile(r.pattern, re.ASCII)) for r in license_scan.rules()]
    names = list(LICENSE_TEXTS.values()) + ["GPL", "Licensed under the Apache License, Version 2.0", "cc by-sa 4.0", "MIT license", "in the public domain"]
    texts = [r.text or "" for r in smoke]
    texts += [f"{a}. {b}" for a in names for b in names[::3]]
    got = {r.doc_id: r for r in license_scan.scan(plain.frame(spark, [plain.row(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        labels, best, found = plain_license(t, rules)
        base = plain.license_base(t)[-1]
        assert got[i].labels == ",".join(sorted(labels | set(filter(None, base.split(","))))), t
        assert got[i].score == max(best, 0.5 if base else 0.0) and got[i].n_found == found


def test_license_gate_is_no_stricter_than_the_rules(spark):
    phrases = {
        "proprietary": "all rights reserved", "public-domain": "in the public domain", "cc-by": "creative commons attribution 4.0",
        "cc-by-nc-sa": "creative commons attribution noncommercial sharealike", "nasa": "nasa open source agreement",
        "cc0": "cc zero", "unicode": "unicode terms of use", "confidential": "proprietary and proprietary", "gpl": "gnu general public license",
        "mit": "mit license", "bsd-2-clause": "2clause bsd", "bsd": "simplified bsd license", "odc-by": "open data commons attribution license",
        "wtfpl": "do what the fuck you want to public license", "cc-by-sa": "cc by sa", "mpl": "mozilla public license", "isc": "isc license",
    }
    texts = [(label, f"so {words.replace(' ', gap)} ok") for label, words in phrases.items() for gap in (" ", "\n", "-", "  ", "\r\n", "\u2013", "\u00a0")]
    texts.append(("cc0", "Creative\nCommons Zero"))
    got = {r.doc_id: r for r in license_scan.scan(plain.frame(spark, [plain.row(i, t) for i, (_, t) in enumerate(texts)])).collect()}
    rules = [(r, re.compile(r.pattern, re.ASCII)) for r in license_scan.rules()]
    for i, (label, text) in enumerate(texts):
        assert label in got[i].labels.split(","), text
        assert got[i].n_found > 0 and got[i].score > 0
    # no rule matches a text that the gate and the rule's keyword leave out
    gate = re.compile("|".join(map(re.escape, license_scan.gates())) + "|" + license_scan.CC_RULE_GATE, re.ASCII)
    for _, text in texts:
        low = text.lower()
        for r, pattern in rules:
            assert not pattern.search(low) or gate.search(low) and any(k in low for k in r.keyword.split("|"))


def test_license_containment(spark):
    spans = spark.createDataFrame([
        (1, "a", "A", 2, 1.0, 10, 20), (1, "b", "B", 1, 1.0, 5, 25), (1, "c", "C", 0, 1.0, 12, 15), (1, "d", "D", 2, 1.0, 20, 30),
        (2, "a", "A", 1, 1.0, 0, 9), (2, "b", "B", 1, 1.0, 0, 9), (2, "c", "C", 3, 1.0, 0, 9)],
        "rid long, rule string, label string, priority int, confidence double, start long, end long")
    assert by_row(license_scan._kept(spans).collect(), "rid", "rule") == [(1, "b"), (1, "c"), (1, "d"), (2, "a")]


def test_license_odd_rows(spark):
    rows = plain.odd_rows() + [plain.row(50, "MIT License " * 3000)]
    got = license_scan.scan(plain.frame(spark, rows)).collect()
    want = [(r[0], *plain.license_base(r[1])) for r in rows]
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert license_scan.scan(plain.frame(spark, [])).count() == 0


# ---- toxicity


def _labelled(spark, n=400):
    rng = random.Random(1)
    bad = ["vile", "rotten", "dreadful"]
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 80)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append(plain.row(i, " ".join(words)))
        labels.append((i, 1, int(toxic), "extra"))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_severity_of_held_out_documents(spark):
    rows, labels = _labelled(spark)
    docs = plain.frame(spark, rows)
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    odd = [d for d in got if d % 2]
    assert all(got[d].rejected == (d % 5 == 0) for d in odd)
    assert model.cuts[0] <= model.cuts[1]
    assert all(0 <= r.p_toxic <= r.severity <= 2 * r.p_toxic + 1e-9 for r in got.values())
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 320


def test_severity_without_basis_and_odd_rows(spark):
    rows, labels = _labelled(spark, 60)
    docs = plain.frame(spark, plain.odd_rows())
    for known in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(plain.frame(spark, rows), known)
        assert model.cuts is None and toxicity.toxicity(docs, model).where("rejected").count() == 0
    model = toxicity.fit(plain.frame(spark, rows), labels)
    assert toxicity.toxicity(docs, model).count() == len(plain.odd_rows())
    assert toxicity.reject_toxic(plain.frame(spark, []), model).count() == 0


def test_toxicity_without_telling_words_rejects_nothing(spark):
    """20 toxic and 20 clean rows: no word has the evidence to get a weight."""
    rows = [plain.row(i, " ".join(f"{a}{i}" for a in "qwertzuiop") + (" awful" if i < 20 else " nice")) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = plain.frame(spark, rows)
    model = toxicity.fit(docs, labels)
    assert model.cuts is not None and not model.weights
    assert toxicity.toxicity(docs, model).where("rejected").count() == 0
    assert toxicity.reject_toxic(docs, model).count() == 40


# ---- helpers


def test_global_index_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").union(spark.range(300).select(F.lit(1).alias("k"), F.lit(7).alias("id")))
    got = common.global_index(df, [F.col("k"), F.col("id")], "at", "test").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(1300))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
