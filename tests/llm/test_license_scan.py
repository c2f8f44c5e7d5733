"""License rules against a loop over all rules and places."""

import random
import re
from re import _parser as parser

from llm_tables import FOLDER, documents, load
from pyspark.sql import functions as F

from stayspark.llm import license_rules, license_scan, queries

RULES = license_rules.rules()
SPLIT = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text, found=RULES):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = SPLIT.findall(lowered)
    line = "".join(f" {w}" for w in words) + " "
    starts = [m.start() for m in re.finditer(" ", line)][:-1]
    hits = []
    for number, rule in enumerate(found):
        if rule.keyword not in line:
            continue
        pattern = re.compile(f"( {rule.pattern}) ")
        for word, at in enumerate(starts):
            match = pattern.match(line, at)
            if match:
                hits.append((word, word + match[1].count(" "), rule.priority, number))
    base = [h for h in hits if found[h[3]].phrase]
    stays = [
        h for h in hits
        if not any(
            o[0] <= h[0] and o[1] >= h[1] and o != h and (o[2], o[0] - o[1], o[3]) < (h[2], h[0] - h[1], h[3])
            for o in hits
        )
    ]
    label = lambda of: ",".join(sorted({found[h[3]].label for h in of}))
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
        label(base), label(base + stays), max((found[h[3]].worth for h in base + stays), default=0.0),
    )


def test_hundreds_of_rules_and_their_keywords():
    assert len(RULES) >= 300
    for rule in RULES:
        re.compile(rule.pattern)


def test_whole_table_equals_the_loop(spark):
    want = sorted((k, *plain(t)) for k, t in load("SELECT doc_id, text FROM documents"))
    got = sorted(tuple(r) for r in queries.QUERIES["op3_license_scan"](spark, FOLDER).collect())
    assert got == want and any(r[5] for r in got)


ODD = [
    (1, None), (2, ""), (3, "..."), (4, "Released UNDER the MIT License, under-the-mit-license."), (5, "CC-BY-NC cc by nc-sa 4.0"),
    (6, "SPDX-License-Identifier: Apache-2.0\nApache License, Version 2.0"), (7, "Licensed under the Apache License, Version 2.0;"),
    (8, "under the mit license" * 3), (9, "under the mit license " * 4000), (10, "É under the mit licenseé"), (11, "cc\x00by nc"),
    (12, "licensed under the terms of the GNU General Public License v3 or the GNU Lesser General Public License version 2.1"),
    (13, "Permission is hereby granted, free of charge, to any person obtaining a copy of"), (14, "All rights reserved."),
    (15, "the İ cc by ncſ"), (16, "K cc by nc"), (17, "a " * 60_000 + "cc by nc"), (17, "cc by nc"), (17, "cc by nc"),
    (18, "http://creativecommons.org/licenses/by-nc-nd/4.0/ unlicense.org"), (None, "mit license"),
]


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("row", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    got = license_scan.scan(docs).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, *plain(t))) for k, t in ODD)


def test_gates_hide_nothing(spark):
    pick = random.Random(7)
    words = sorted({w for r in RULES for w in re.findall(r"[a-z0-9]{2,}", re.sub(r"\(\?:|\[cs\]", " ", r.pattern))})
    texts = [" ".join(pick.choices(words, k=12)) for _ in range(100)]
    for rule in RULES:  # the plainest text that each rule finds
        text = re.sub(r"\[cs\]", "c", rule.pattern).replace(" ?", " ")
        while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)) != text:
            text = new
        texts.append(re.sub(r"\[(.).*?\]", r"\1", text).replace("?", ""))
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(bool(r[5]) for r in got.values()) >= 300
    ungated = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(docs, gates=None).collect()}
    assert ungated == got


def variants(pattern):
    """Every text of a rule's pattern: each branch, and each optional group with and without it."""

    def walk(items):
        texts = [""]
        for kind, value in items:
            if kind == parser.LITERAL:
                some = [chr(value)]
            elif kind == parser.IN:  # [cs], and [1-4]
                some = [chr(v if k == parser.LITERAL else v[0]) for k, v in value]
            elif kind == parser.SUBPATTERN:
                some = walk(value[3])
            elif kind == parser.BRANCH:
                some = [t for branch in value[1] for t in walk(branch)]
            else:
                assert kind == parser.MAX_REPEAT and value[:2] == (0, 1)
                some = ["", *walk(value[2])]
            texts = [a + b for a in texts for b in some]
        return texts

    return walk(parser.parse(pattern))


def test_every_text_of_every_rule_holds_a_gate_and_its_keyword():
    for rule in RULES:
        for text in variants(rule.pattern):
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text, (rule, text)
            assert any(gate in text for gate in license_rules.GATES), (rule, text)


def test_grants_without_the_word_license(spark):
    texts = [min(variants(r.pattern), key=len) for r in RULES]
    texts += [
        "released under MIT", "Distributed under the terms of Apache 2.0.", "available under MPL 2.0", "Published under the 3-Clause BSD",
        "used by ISC", "covered by the EUPL 1.2", "provided under zlib", "released under Expat", "Licensed under the Expat license",
    ]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(docs).collect()}
    assert got == {r.doc_id: tuple(r)[1:] for r in license_scan.scan(docs, gates=None).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert all(r[5] for r in got.values())
    assert [got[len(RULES) + i][5:] for i in (0, 1, 7)] == [("mit", 0.95), ("apache-2", 0.95), ("mit", 0.95)]


def test_phrases_that_overlap_themselves(spark):
    found = license_rules.rules({"a b a": "x"})[:1]
    got = license_scan.scan(documents(spark, [(1, "a b a b a c a b a")]), found, None).collect()
    assert tuple(got[0])[1:] == (9, 3, 0, 6, "x", "x", 0.95)


def test_no_rows_and_no_python(spark):
    none = license_scan.scan(documents(spark, []))
    assert none.collect() == []
    plan = none._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
