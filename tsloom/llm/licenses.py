"""Licence scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are runs of lines between blank lines. A multinomial logistic regression (Spark ML) over sparse one- and two-word n-grams
judges each of them: one class for each licence family, one for licences of no known family, and one for text that is no licence. It
is trained here, on fragments of notices set among random words, on declarations of other licences, and on harmless or negated
sentences in which the same words occur. A temperature, fitted on held-out fragments, calibrates its probabilities.

A paragraph is judged in passages: words that every notice has some of (CUES) start them, so a paragraph without such a word is
none without being asked, and a long one is as many passages of at most WINDOW words as it needs. A passage that is a licence with
a probability of at least CONFIDENT proposes the families that have at least PROPOSED of it. Each is confirmed by comparison with
its templates: a stretch of the passage that has at least CONFIRM of the two-word n-grams of a notice, with words that tell the
family from its kin (KEYS), no negation right before it, and of which the classifier, asked about the notice's words alone, names
the family as surely. A licence passage of which no family is confirmed is reported as unknown.

Nulls and odd input: null, empty and wordless texts have no paragraphs and no licence. Rows are judged one by one, so
repeated rows, ties and null ids need no rule. An empty table gives an empty result. Other input columns are kept;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WINDOW = 80
CONFIDENT, CONFIRM, PROPOSED = 0.7, 0.6, 0.02
TRAIN_ROWS, HELD_OUT, SEED = 6000, 0.25, 11
UNKNOWN = "unknown"
#: Words between two cues of one passage at most, and words taken with the first and the last.
REACH = 20
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
#: Notices by which licences are commonly declared, and parts of their texts.
NOTICES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", "apache license version 2.0 january 2004", "spdx license identifier apache 2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"],
    "bsd-2-clause": ["released under the 2 clause bsd license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause", "licensed under the simplified bsd license"],
    "bsd-3-clause": ["released under the 3 clause bsd license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "spdx license identifier cc by 4.0"],
    "cc-by-nc-4.0": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0", "spdx license identifier cc by nc 4.0"],
    "cc-by-sa-4.0": ["this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0", "spdx license identifier cc by sa 4.0"],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "released under cc0 1.0 universal public domain dedication", "spdx license identifier cc0 1.0"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", f"{_GPL} 2", "spdx license identifier gpl 2.0 only", "licensed under gpl 2.0 or later", "gnu general public license v2.0"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", f"{_GPL} 3", "spdx license identifier gpl 3.0 only", "licensed under gpl 3.0 or later", "gnu general public license v3.0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx license identifier isc", "the software is provided as is and the author disclaims all warranties with regard to this software"],
    "lgpl-3.0": ["licensed under the gnu lesser general public license version 3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx license identifier lgpl 3.0 only", "spdx license identifier lgpl 3.0 or later", "gnu lesser general public license v3.0"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "released under the mit license", "licensed under the mit license", "mit license", "spdx license identifier mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without prior written permission", "proprietary and confidential unauthorized copying is strictly prohibited"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "spdx license identifier unlicense"],
}
#: N-grams that tell a family from its kin; all of one line must be in a stretch.
KEYS = {
    "agpl-3.0": [["affero general"], ["agpl 3.0"]],
    "apache-2.0": [["apache license", "version 2.0"], ["apache 2.0"], ["www apache"], ["as is", "basis"]],
    "bsd": [["redistribution and"], ["redistributions of"], ["bsd license"], ["holders and"]],
    "bsd-2-clause": [["2 clause"], ["simplified bsd"]],
    "bsd-3-clause": [["3 clause"], ["neither the", "endorse or"]],
    "cc-by-4.0": [["attribution 4.0"], ["by 4.0"]],
    "cc-by-nc-4.0": [["noncommercial 4.0"], ["by nc"]],
    "cc-by-sa-4.0": [["sharealike 4.0"], ["by sa"]],
    "cc0-1.0": [["has waived"], ["cc0 1.0"]],
    "gpl-2.0": [["gnu general", "version 2"], ["gnu general", "license v2.0"], ["gpl 2.0"]],
    "gpl-3.0": [["gnu general", "version 3"], ["gnu general", "license v3.0"], ["gpl 3.0"]],
    "isc": [["or distribute", "or without"], ["isc license"], ["identifier isc"], ["author disclaims"]],
    "lgpl-3.0": [["lesser general"], ["lgpl 3.0"]],
    "mit": [["hereby granted", "free of"], ["mit license"], ["identifier mit"], ["as is", "without warranty"], ["permission notice"]],
    "mpl-2.0": [["mozilla public"], ["mpl 2.0"]],
    "proprietary": [["rights reserved", "no part"], ["and confidential"]],
    "unlicense": [["unencumbered software"], ["compile sell"], ["identifier unlicense"]],
}
#: Declarations of licences of no family above; {0} and {1} stand for a made-up name and a number.
OTHERS = [
    "licensed under the eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the common development and distribution license", "released under the artistic license 2.0", "released under the zlib license",
    "distributed under the boost software license version 1.0", "licensed under the sil open font license version 1.1", "licensed under the european union public licence version 1.2", "licensed under the gnu general public license version 1", "licensed under the microsoft public license", "spdx license identifier epl 2.0",
    "licensed under the {0} license", "licensed under the {0} license version {1}", "released under the {0} public license version {1}", "distributed under the terms of the {0} license", "this work is licensed under the {0} licence", "this software is licensed under {0} license {1}", "spdx license identifier {0} {1}", "use of this software is governed by the {0} license agreement",
]
#: Harmless sentences that share words with notices; and what negates one.
HARMLESS = [
    "he showed his driving license to the police and was released", "the public library is open and free of charge to any person", "the version of the story that was published under his name", "we were granted permission to use the general hall",
    "a work of creative people in common places", "the international conditions are met in the following source", "copy the form and modify the terms", "a license to fish is required under the law of the state", "the university of apache county and the foundation", "software version 2 was distributed to the users",
    "all rights and duties of the author are set out in the law", "this file is part of the program of the festival", "no part of the road was open", "the mit campus and the bsd conference", "attribution of the work to the author is disputed", "he lost his license", "the doctor lost her license to practise", "the pub has a license until midnight",
    "she asked for permission to park", "the warranty covers any kind of fault", "the license plate of the car", "a licensed driver of the bus", "copyright law is taught in the second year", "the domain of the public authority",
]
NEGATIONS = frozenset("not never no neither isn wasn aren cannot without nor unlike instead".split())
#: Words of which each notice and declaration has one at least.
CUES = frozenset(
    "license licence licensed licensing licenses licences gpl lgpl agpl spdx bsd mit apache mozilla mpl isc cc cc0 creative commons copyright gnu permission redistribution redistributions warranty warranties unencumbered unlicense hereby waived rights proprietary confidential distribute contributors".split()
)
FAMILIES = sorted(NOTICES)
OTHER, NONE = len(FAMILIES), len(FAMILIES) + 1
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def vocabulary() -> dict[str, int]:
    texts = [*(n for ns in NOTICES.values() for n in ns), *(o.replace("{0}", "").replace("{1}", "") for o in OTHERS), *HARMLESS]
    found = set().union(*(ngrams(words_of(t)) for t in texts))
    found |= {f"{n} {w}" for n in NEGATIONS for w in ("licensed", "under", "released", "covered", "the", "a", "subject", "distributed")} | NEGATIONS
    return {g: i for i, g in enumerate(sorted(found))}


def training_rows(n: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[int, list[str]]]:
    """(class, words): fragments of notices, other declarations and harmless or negated sentences among random words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeghilnorstu") for _ in range(rng.randint(2, 9)))
    some = lambda k: [word() for _ in range(k)]
    common = sorted({w for ns in NOTICES.values() for x in ns for w in words_of(x)})
    rows = []
    for _ in range(n):
        draw = rng.random()
        if draw < 0.55:
            k = rng.randrange(len(FAMILIES))
            ws = words_of(rng.choice(NOTICES[FAMILIES[k]]))
            ws = [w for w in ws if rng.random() > 0.05] if len(ws) > 6 else ws
            if len(ws) > 12 and rng.random() < 0.5:
                a = rng.randint(0, len(ws) // 4)
                ws = ws[a : len(ws) - rng.randint(0, len(ws) // 4)]
        elif draw < 0.7:
            k, ws = OTHER, words_of(rng.choice(OTHERS).format(" ".join(some(rng.randint(1, 3))), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}"))
        else:
            k = NONE
            kind = rng.random()
            if kind < 0.4:
                ws = words_of(rng.choice(HARMLESS))
            elif kind < 0.7:
                whole = words_of(rng.choice([x for ns in NOTICES.values() for x in ns if len(words_of(x)) < 12] + OTHERS[:11]))
                at = next((i for i, w in enumerate(whole) if w in ("licensed", "released", "distributed")), 0)
                ws = [*whole[:at], rng.choice(sorted(NEGATIONS)), *whole[at:]]
            else:
                ws = rng.sample(common, rng.randint(0, 12))
        rows.append((k, some(rng.randint(0, 25)) + ws + some(rng.randint(0, 40))))
    return rows


def _probabilities(weights: np.ndarray, bias: np.ndarray, found: list[int], heat: float) -> np.ndarray:
    z = (bias + weights[found].sum(axis=0)) / heat
    z = np.exp(z - z.max())
    return z / z.sum()


def train(spark: SparkSession) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (n-gram, class), biases and the temperature."""
    vocab = vocabulary()
    rows = [(k, sorted(vocab[g] for g in ngrams(ws) if g in vocab)) for k, ws in training_rows()]
    cut = int(len(rows) * (1 - HELD_OUT))
    df = spark.createDataFrame([(float(k), Vectors.sparse(len(vocab), f, [1.0] * len(f))) for k, f in rows[:cut]], ["label", "features"]).coalesce(1)
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, standardization=False).fit(df)
    weights, bias = model.coefficientMatrix.toArray().T.copy(), model.interceptVector.toArray()
    loss = lambda h: -sum(math.log(max(_probabilities(weights, bias, f, h)[k], 1e-12)) for k, f in rows[cut:])
    return weights, bias, min((0.25 * 1.15**i for i in range(24)), key=loss)


class Scanner:
    """Judges texts with a trained model."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.weights, self.bias, self.heat, self.vocab = weights, bias, heat, vocabulary()
        self.notices = {f: [set(map(" ".join, zip(w, w[1:], strict=False))) for w in map(words_of, ns)] for f, ns in NOTICES.items()}

    def _stretches(self, places: list[tuple[int, str]], need: float) -> list[list[int]]:
        """Of the places (position, n-gram) of a notice's n-grams, those of stretches that have at least need different ones."""

        def grown(s: int) -> list[int]:
            seen, out = set(), []
            for i, g in places[s : s + WINDOW]:
                if i - places[s][0] >= WINDOW:
                    break
                if g not in seen:
                    seen.add(g)
                    out.append(i)
            return out

        found, s = [], 0
        while s < len(places):
            best = grown(s)
            if len(best) < need:
                s += 1
                continue
            t = s + 1
            while t < len(places) and places[t][0] <= best[-1]:  # a later start may have more of the notice, or as much in fewer words
                other = grown(t)
                if (len(other), best[-1] - best[0]) > (len(best), other[-1] - other[0]):
                    best = other
                t += 1
            found.append(best)
            while s < len(places) and places[s][0] <= best[-1]:
                s += 1
        return found

    def _ask(self, words: list[str]) -> np.ndarray:
        return _probabilities(self.weights, self.bias, sorted(self.vocab[g] for g in ngrams(words) if g in self.vocab), self.heat)

    def passages(self, ws: list[str]) -> list[tuple[int, int]]:
        """Begin and end of the passages of a paragraph's words, of at most WINDOW words, half of which the next one shares."""
        out, cues = [], [i for i, w in enumerate(ws) if w in CUES]
        while cues:
            k = next((k for k in range(1, len(cues)) if cues[k] - cues[k - 1] > REACH), len(cues))
            a, b = max(0, cues[0] - REACH), min(len(ws), cues[k - 1] + REACH + 1)
            out += [(c, min(c + WINDOW, b)) for c in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2)]
            cues = cues[k:]
        return out

    def _confirmed(self, family: str, ws: list[str], pairs: list[str]) -> tuple[float, int, int] | None:
        """(probability, begin, end) of the family's best confirmed stretch of a passage."""
        best = None
        for notice in self.notices[family]:
            places = [(i, g) for i, g in enumerate(pairs) if g in notice]
            for x in self._stretches(places, CONFIRM * len(notice)) if len({g for _, g in places}) >= CONFIRM * len(notice) else []:
                held = {pairs[i] for i in x} | {w for i in x for w in (ws[i], ws[i + 1])}
                if not any(all(k in held for k in keys) for keys in KEYS[family]) or NEGATIONS & set(ws[max(0, x[0] - 3) : x[0]]):
                    continue
                told = [w for i in range(x[0], x[-1] + 2) for w in [ws[i]] if i in x or i - 1 in x]
                p = float(self._ask(told)[FAMILIES.index(family)])
                if p >= CONFIDENT and (best is None or p > best[0]):
                    best = (p, x[0], x[-1] + 2)
        return best

    def paragraph(self, ws: list[str]) -> dict[str, float]:
        """Family, or unknown, and probability of each licence of a paragraph's words."""
        found: dict[str, float] = {}
        taken: list[tuple[int, int]] = []
        open_: list[tuple[int, int, float]] = []
        for a, b in self.passages(ws):
            part = ws[a:b]
            p = self._ask(part)
            likely = 1 - float(p[NONE])
            if likely < CONFIDENT:
                continue
            pairs = list(map(" ".join, zip(part, part[1:], strict=False)))
            confirmed = {f: c for k, f in enumerate(FAMILIES) if p[k] >= PROPOSED and (c := self._confirmed(f, part, pairs))}
            for f, (q, x, y) in confirmed.items():
                found[f] = max(q, found.get(f, 0.0))
                taken.append((a + x, a + y))
            if not confirmed:
                open_.append((a, b, likely))
        for a, b, likely in open_:  # a passage that shares words with a confirmed stretch is the rest of that licence
            if not any(x < b and a < y for x, y in taken):
                found[UNKNOWN] = max(likely, found.get(UNKNOWN, 0.0))
        if {"bsd-2-clause", "bsd-3-clause"} & set(found):
            found.pop("bsd", None)
        return found

    def text(self, text: str | None) -> tuple[int, list[tuple[int, str, float]]]:
        """Number of paragraphs, and (paragraph, family, probability) of all licences, each once a paragraph."""
        blocks = [words_of(x) for x in _BLANK_LINE.split(text or "") if x.strip()]
        return len(blocks), [(i, f, p) for i, ws in enumerate(blocks) for f, p in sorted(self.paragraph(ws).items())]


_FOUND = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType())]))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, but with n_paragraphs, licenses (array of paragraph, family, probability) and license (of the surest paragraph, or null)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.sparkSession))  # a few thousand weights
    made = {"n_paragraphs": T.LongType(), "licenses": _FOUND, "license": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in {text_col.lower(), *made}]
    names = [f.name for f in kept]

    def run(batches):
        scanner = Scanner(*sent.value)
        for b in batches:
            rows = [scanner.text(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
            found = pa.array([[{"paragraph": i, "family": f, "probability": p} for i, f, p in hits] for _, hits in rows], pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())])))
            best = pa.array([max(hits, key=lambda h: (h[2], -h[0]))[1] if hits else None for _, hits in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array([n for n, _ in rows], pa.int64()), found, best], names=[*names, *made])

    return docs.mapInArrow(run, T.StructType([*kept, *[T.StructField(k, t) for k, t in made.items()]]))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).selectExpr("doc_id", "n_paragraphs", "cast(size(licenses) AS long) AS n_licensed", "license", "array_join(transform(licenses, x -> concat(x.paragraph, ':', x.family)), ',') AS found")
