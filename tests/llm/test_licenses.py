import random
import re

import pytest

from tsloom.llm import licenses


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.Scanner(*licenses.train(spark))


def test_held_out_accuracy(scanner):
    right = sure = sure_right = 0
    rows = licenses.training_rows(800, seed=77)
    for k, ws in rows:
        p = scanner._ask(ws)
        right += p.argmax() == k
        if p.max() > 0.9:
            sure += 1
            sure_right += p.argmax() == k
    assert right / len(rows) > 0.9 and sure_right / sure > 0.97


#: Forms that no generator of the training makes.
FORMS = [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}),
    ("// SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
    ("Licensed under GPL-2.0-or-later", {"gpl-2.0"}),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", {"apache-2.0"}),
    ("The MIT License\n\nCopyright (c) 2020 Jane Doe", {"mit"}),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', {"mit"}),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", {"unknown"}),
    ("Licensed under the GNU General Public License version 1", {"unknown"}),
    ("licensed under the GNU General Public License version 2 or version 3", {"gpl-2.0", "gpl-3.0"}),
    ("This file is not licensed under the MIT license.", set()),
    ("It was never released under the ISC license", set()),
    ("Licensed under the MIT license or the Apache License, Version 2.0.", {"mit", "apache-2.0"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", {"bsd"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: ... Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd-3-clause"}),
    ("Released under the BSD 3-Clause License", {"bsd-3-clause"}),
    ("Published under CC BY-SA 4.0", {"cc-by-sa-4.0"}),
    ("GNU Lesser General Public License v3.0", {"lgpl-3.0"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", {"mpl-2.0"}),
    ("Licensed under the Some Other License, version 9.", {"unknown"}),
    ("He lost his license.", set()),
    ("Our licence to sell beer was renewed under the new law", set()),
    ("The university granted permission to copy the map.", set()),
    ("Copyright (c) 2020 Jane Doe", set()),
]


def test_forms_that_training_does_not_make(scanner):
    wrong = [(t, {f for _, f, _ in scanner.text(t)[1]}, want) for t, want in FORMS if {f for _, f, _ in scanner.text(t)[1]} != want]
    assert not wrong, wrong


def test_every_notice_confirms_its_family_and_has_a_cue(scanner):
    for family, notices in licenses.NOTICES.items():
        for n in notices:
            assert licenses.CUES & set(licenses.words_of(n)), n
            assert [f for _, f, _ in scanner.text(n)[1]] == [family], n
            assert any(all(k in licenses.ngrams(licenses.words_of(n)) for k in keys) for keys in licenses.KEYS[family]), n


def test_confirmation_against_plain_comparison(scanner):
    """Every confirmed stretch has the share of some template's two-word n-grams that confirms, counted here over all windows."""
    rng = random.Random(3)
    every = [(f, n) for f, ns in licenses.NOTICES.items() for n in ns]
    for _ in range(150):
        f, n = rng.choice(every)
        ws = [w for w in licenses.words_of(n) if rng.random() > 0.25]
        ws = ["bla"] * rng.randint(0, 5) + ws + ["blu"] * rng.randint(0, 5)
        pairs = list(zip(ws, ws[1:]))
        best = 0.0
        for m in licenses.NOTICES[f]:
            wanted = set(zip(licenses.words_of(m), licenses.words_of(m)[1:]))
            best = max(best, max((len(wanted & set(pairs[a : a + licenses.WINDOW])) / len(wanted) for a in range(len(pairs))), default=0))
        found = scanner._confirmed(f, ws, [" ".join(p) for p in pairs])
        assert not (found and best < licenses.CONFIRM), (f, ws)


def test_query_finds_planted_notices_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    told = {"mit license": "mit", "apache license": "apache-2.0", "cc by-nc": "cc-by-nc-4.0", "gnu general public": "gpl-3.0"}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in licenses.op2_licenses(spark, sf).collect()}
    assert len(rows) == len(texts)
    planted = 0
    for i, t in texts.items():
        want = {v for k, v in told.items() if k in t.lower()}
        planted += bool(want)
        got = {x.split(":")[1] for x in rows[i].found.split(",") if x}
        assert got == want, (i, got, want, re.findall(r"[^\n]{0,40}licens[^\n]{0,80}", t, re.I))
    assert planted > 5


def test_odd_rows(spark):
    long = "x " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files" + " y" * 5000
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "\n \n"), (4, long), (None, "He lost his license."), (5, "Licensed under the Some Other License, version 9.")], "doc_id long, text string").selectExpr("*", "9 AS License")
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert [by[i].license for i in (1, 2, 3, 4, None, 5)] == [None, None, None, "mit", None, "unknown"]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_two_licences_in_a_line_long_texts_and_wrapped_notices(spark):
    mit, apache = "Licensed under the MIT license", "the Apache License, Version 2.0"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    filler = " nolo" * 300
    texts = [f"{mit} or {apache}.", f"{mit}{filler} Licensed under {apache}{filler} Released under the ISC license", "head\n\n" + gpl, f"{mit}\nword\nLicensed under {apache}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.paragraph, x.family) for x in r.licenses] for r in licenses.scan_licenses(df).collect()}
    assert got == {0: [(0, "apache-2.0"), (0, "mit")], 1: [(0, "apache-2.0"), (0, "isc"), (0, "mit")], 2: [(1, "gpl-3.0")], 3: [(0, "apache-2.0"), (0, "mit")]}
