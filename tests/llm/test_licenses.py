import re

import pytest
from frames import CLASHES, clashing, frame, hard_rows, words
from pyspark.sql import functions as F

from opswell.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    w = WORD.findall(lower(text))
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in out]
    return len(w), len(out), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in out}))


def spans(text):
    """All matches of all rules, then those inside another of the same or a higher priority dropped."""
    w = WORD.findall(lower(text))
    line = "".join(f" {x}" for x in w) + " "
    hits = []
    if any(k in (text or "").lower() for k in licenses.GATE):
        for r in licenses.rules():
            if r.keyword in line:
                for m in re.finditer(f"(?<= )(?:{r.expression})(?= )", line):
                    first = line[: m.start()].count(" ") - 1
                    hits.append((first, first + m[0].count(" ") + 1, r.number, r.priority, r.label))
    order = sorted(hits, key=lambda h: (h[0], -h[1], h[3], h[2]))
    kept = [h for i, h in enumerate(order) if not any(g[0] <= h[0] and g[1] >= h[1] and g[3] <= h[3] for g in order[:i])]
    return [(a, b, n, label) for a, b, n, _, label in kept]


TEXTS = [
    "Licensed under the MIT License. MIT license, mit-license mit  LICENSE mitlicense",
    "SPDX-License-Identifier: GPL-3.0-only\nThis program is free software; you can redistribute it",
    "GNU General Public License, general public license; the Lesser General Public License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. MIT License. Copyright (c) 2001 2002 me. All rights reserved",
    "License", "MIT", "Licence: Apache License 2.0 under the terms of the Apache License, Version 2.0", "no such words at all", "É license à mit license日本 mit license",
    "mit license " * 400, "bsd 3 clause license or new bsd license without any warranty", "\u212a license mit \u0130 license",
]


def check(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    scanned = licenses.scan(frame(spark, rows), ["doc_id"])
    got = {r.doc_id: r for r in scanned.collect()}
    digests = {r.doc_id: r for r in licenses.digest(scanned).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        d = digests[i]
        assert (d.n_words, d.n_base, d.first_word, d.last_word, d.base_labels) == base(t), t
        assert sorted((s.first, s.until, s.rule, s.label) for s in got[i].spans) == sorted(spans(t)), t
        assert set(filter(None, d.labels.split(","))) == set(filter(None, d.base_labels.split(","))) | {s[3] for s in spans(t)}
        assert 0 <= d.score < 1 or d.n_base > 40 and d.score == 1


def test_texts_with_and_without_signatures(spark):
    check(spark, TEXTS + [words(1, 400) + " mit license " + words(2, 400)])


def test_hard_rows(spark):
    check(spark, [r[1] for r in hard_rows()])


def test_every_rule_matches_a_text_made_for_it():
    assert len(licenses.rules()) > 300 and [r.priority for r in licenses.rules()] == sorted(r.priority for r in licenses.rules())
    for text, label in (("licensed under the zlib license", "zlib"), ("see the mozilla public license", "mpl"), ("spdx license identifier cc0 1 0", "cc0")):
        assert label in {s[3] for s in spans(text)}


def test_gate_holds_for_every_rule():
    """A text that a rule can match holds a word of the gate."""
    for r in licenses.rules():
        assert any(g in r.keyword or re.sub(r"[^a-z ]", "", r.expression).find(g) >= 0 for g in (*licenses.GATE, "licenc")) or r.keyword in (
            "permission is hereby granted", "redistribution", "free software", "permission to use", "express or implied", "all rights reserved"
        ) or r.priority in (2, 3), r


def every_match(text):
    """Spans that stay, found without gate and keywords."""
    line = "".join(f" {x}" for x in WORD.findall(lower(text))) + " "
    hits = []
    for r in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{r.expression})(?= )", line):
            first = line[: m.start()].count(" ") - 1
            hits.append((first, first + m[0].count(" ") + 1, r.number, r.priority, r.label))
    order = sorted(hits, key=lambda h: (h[0], -h[1], h[3], h[2]))
    kept = [h for i, h in enumerate(order) if not any(g[0] <= h[0] and g[1] >= h[1] and g[3] <= h[3] for g in order[:i])]
    return sorted((a, b, n, label) for a, b, n, _, label in kept)


def scanned(spark, texts):
    got = licenses.scan(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), ["doc_id"]).collect()
    return {texts[r.doc_id]: sorted((s.first, s.until, s.rule, s.label) for s in r.spans) for r in got}


def test_texts_without_common_license_words(spark):
    texts = [
        "All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "released under the GNU GPL v3", "distributed under BSD", "in the\n\nis in the public \n domain now",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "This program is free software: you can redistribute it", "dedicated to the public\n\ndomain", "no such words",
    ]
    got = scanned(spark, texts)
    assert all(got[t] == every_match(t) for t in texts) and all(got[t] for t in texts[:-1]) and not got[texts[-1]]


def test_every_alternative_holds_its_keyword():
    for r in licenses.rules():
        assert r.words and all(r.keyword in t and set(r.words) & set(t.split()) for t in licenses.wordings(r.expression)), r


def test_each_alternative_is_found(spark):
    """A text for every wording of every name, and of every form with one name, against a scan without gate and keywords."""
    texts = {f"under the terms of the {t} license" for _, _, names in licenses.FAMILIES for t in licenses.wordings(names)}
    texts |= {f"{b}{t}" for _, before, _ in licenses.FORMS for b in licenses.wordings(before) for t in ("wtfpl license", "q public license", "cc by nc 4 0", "zero clause bsd")}
    texts |= {t for *_, expression in licenses.SENTENCES for t in licenses.wordings(expression)}
    texts |= {"Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-No Derivatives license", "AFL 3.0 licensed"}
    got = scanned(spark, sorted(texts))
    assert {t: [s[3] for s in got[t]] for t in texts} == {t: [s[3] for s in every_match(t)] for t in texts}
    assert all(got[t] == every_match(t) for t in texts)
    assert {s[3] for s in got["Licensed under CC BY-NC 4.0."]} == {"cc-by-nc"}


def test_clashing_columns_and_no_rows(spark):
    docs = clashing(frame(spark, [(1, "MIT License", None, None, None)] * 3))
    scanned = licenses.scan(docs, ["doc_id", *[c for c in CLASHES]])
    assert [r.n_words for r in scanned.collect()] == [2, 2, 2] and scanned.first()["score"] == "own score"
    assert licenses.digest(licenses.scan(frame(spark, []), ["doc_id"])).count() == 0


def test_main_path_is_native(spark):
    plan = licenses.scan(frame(spark, hard_rows()), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op4_license_scan"])
def test_whole_table(spark, tables, name):
    from opswell.llm.queries import QUERIES

    rows = QUERIES[name](spark, tables.folder).orderBy("doc_id").collect()
    docs = tables.documents.orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [(d.doc_id, *base(d.text)) for d in docs]
    assert tables.documents.filter(F.lower("text").contains("license")).count() == 0 or any(r.labels for r in rows)
