import math
import re

import pytest

from tripwire.llm import licenses as L

from .cases import DOC_SCHEMA, documents


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.createDataFrame(documents(), DOC_SCHEMA))


def scan(spark, model, texts):
    docs = spark.createDataFrame([(i, t, 1.0, "y") for i, t in enumerate(texts)], "doc_id long, text string, prob double, line string")
    return {(r["doc_id"], r["paragraph"]): r for r in L.scan(docs, model).collect()}


def test_templates_are_found_and_confirmed(spark, model):
    texts = [f"some words\n{t}\nmore words" for f in L.FAMILIES if f != "unknown" for t in L.TEMPLATES[f]]
    names = [f for f in L.FAMILIES if f != "unknown" for _ in L.TEMPLATES[f]]
    got = scan(spark, model, texts)
    assert [i for i, f in enumerate(names) if not ((i, 1) in got and got[i, 1]["family"] == f and got[i, 1]["confirmed"])] == []
    assert all(k[1] == 1 for k in got)


def test_short_forms(spark, model):
    names = {"Creative Commons Attribution 4.0 International": "creative_commons", "CC BY-SA 4.0": "creative_commons", "CC0 1.0 Universal": "creative_commons",
             "AGPL-3.0-or-later": "gpl", "LGPL-2.1": "gpl", "GPL-2.0-only": "gpl", "BSD-3-Clause": "bsd", "Apache-2.0": "apache",
             "Distributed under the Boost Software License, Version 1.0.": "boost",
             "This is free and unencumbered software released into the public domain.": "unlicense"}
    got = scan(spark, model, list(names))
    assert [got[i, 0]["family"] for i in range(len(names))] == list(names.values())


def words(t):
    return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]


def grams(t, n):
    w = words(t)
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(model, texts):
    """Every line and run scored in plain Python, without any gate."""
    table = {g: [round(float(x), 6) for x in model.weights[:, j]] for j, g in enumerate(model.vocabulary)}
    out = {}
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        spans = [(i, i) for i in range(len(lines))]
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j].strip(" \t\n\x0b\f\r"):
                j += 1
            if j - i > 1:
                spans.append((i, j - 1))
            i = max(j, i + 1)
        found = {}
        for a, z in spans:
            text = " ".join(lines[a:z + 1])
            hit = [table[g] for g in grams(text, 1) | grams(text, 2) | grams(text, 3) if g in table]
            score = [(b + sum(h[k] for h in hit)) / model.temperature for k, b in enumerate(model.intercepts)]
            e = [math.exp(x - max(score)) for x in score]
            k = e.index(max(e))
            if max(e) / sum(e) >= L.MIN_PROB and k != L.UNKNOWN:
                pairs = grams(text, 2)
                sims = [len(grams(x, 2) & pairs) / len(grams(x, 2)) for x in L.TEMPLATES[L.FAMILIES[k]] if grams(x, 2)]
                found[a, z] = (L.FAMILIES[k], max(e) / sum(e), sum(x >= L.CONFIRM for x in sims), max(sims))
        runs = {s: v for s, v in found.items() if s[0] < s[1] and v[2] > sum(
            x[2] for (a, z), x in found.items() if a == z and s[0] <= a <= s[1] and x[0] == v[0])}
        for (a, z), v in found.items():
            inside = a == z and any(s[0] <= a <= s[1] and r[0] == v[0] for s, r in runs.items())
            if ((a, z) in runs) or (a == z and not inside):
                out.setdefault((d, a), []).append((v[0], round(v[1], 4), round(v[3], 6)))
    return {k: sorted(v) for k, v in out.items()}


def test_against_scoring_every_paragraph(spark, model):
    rows = [r[1] for r in documents()]
    texts = [*rows[:60], *WRAPPED.values(), "x\n" + "\n".join(WRAPPED.values()) + "\n\ny", *L.TEMPLATES["unknown"], "GPL\nMIT License\n\nlicence", "\n\n",
             *[f"w1x {t} w2x\n{t[:40]}\n \n{t}" for f in L.FAMILIES for t in L.TEMPLATES[f]],
             " ".join(rows[5:60:7]) + " Licensed under the MIT license. " + "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in L.scan(docs, model).collect():
        got.setdefault((r["doc_id"], r["paragraph"]), []).append((r["family"], round(r["prob"], 4), round(r["similarity"], 6)))
    want = brute(model, texts)
    assert len(want) > 100
    assert {k: [x[0] for x in sorted(v)] for k, v in got.items()} == {k: [x[0] for x in v] for k, v in want.items()}
    assert all(a == pytest.approx(b, abs=2e-4) for k, v in want.items() for x, y in zip(sorted(got[k]), v, strict=True) for a, b in ((x[1:], y[1:]),))


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the
Software without restriction""",
    "apache": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance
# with the License. You may obtain a copy of the License at
#   http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """ * This program is free software: you can redistribute it
 * and/or modify it under the terms of the GNU General
 * Public License as published by the Free
 * Software Foundation""",
    "bsd": """Redistribution and use in source and binary forms,
with or without modification, are permitted provided
that the following conditions are met:""",
}


def test_wrapped_notices(spark, model):
    got = scan(spark, model, [f"some words\nof a text\n \n{t}\n\nmore words" for t in WRAPPED.values()])
    for i, (family, t) in enumerate(WRAPPED.items()):
        mine = {k: r for k, r in got.items() if k[0] == i and r["family"] == family}
        assert list(mine) == [(i, 3)], (family, got)
        r = mine[i, 3]
        assert r["confirmed"] and r["line"] == t.replace("\n", " ")


def test_lines_of_a_run_stay_lines(spark, model):
    got = scan(spark, model, ["Released under the MIT License.\nother words\nLicensed under CC BY 4.0."])
    assert {k: (r["family"], r["confirmed"]) for k, r in got.items()} == {(0, 0): ("mit", True), (0, 2): ("creative_commons", True)}


def test_variations_that_training_did_not_see(spark, model):
    texts = ["This document is Released under the MIT License, enjoy.", "*** Licensed under the Apache License, Version 2.0 ***",
             "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "licensed under cc by-nc 4.0"]
    got = scan(spark, model, texts)
    assert [got[i, 0]["family"] for i in range(4)] == ["mit", "apache", "gpl", "creative_commons"]
    assert all(0.5 <= r["prob"] <= 1 and r["confirmed"] for r in got.values())


def test_unknown(spark, model):
    texts = [*L.TEMPLATES["unknown"], "license", "my licence photo", "permission", "w1x w2x w3x", "", None, "  \n \n"]
    assert [r for r in scan(spark, model, texts).values() if r["confirmed"]] == []


def test_repeated_rows_nulls_and_empty(spark, model):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (2, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in L.scan(docs, model).collect()) == ["1", "1", "None"]
    e = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(e, model).collect() == [] and L.scan(docs, L.fit(e)).count() == 3


def test_only_dataframe_functions(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = L.scan(docs, model)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
