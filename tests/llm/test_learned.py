"""Neighbours, licences, toxicity, language, mixing, and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from casemill.llm import ann, langid, licenses, mixing, toxicity


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 15))
    x[50:90] = x[40]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(1000, None, 1, 2), (1020, [0.0] * 15, 1, 2), (1040, [float("nan")] * 15, 1, 2), (1060, [1.0], 1, 2), (None, [1.0] * 15, 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    out = ann.nearest(frame, k=10, index_block=300, query_block=16).orderBy("query_id", "rank").toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:10]
        hits += len(set(best) & set(g.vec_id))
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, x[g.vec_id] @ x[q], rtol=0, atol=1e-12)
    assert out.query_id.nunique() == 45 and hits >= 0.9 * 450
    twins = out[(out.query_id == 40) & (out.score > x[40] @ x[40] - 1e-9)].vec_id.tolist()
    assert twins == list(range(50, 60))


def test_neighbours_in_a_crowd(spark):
    """A third of the rows are near copies of one vector, many more than are reranked first."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[::3] = x[0] + 0.01 * rng.normal(size=(1000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(frame, k=20).toPandas()
    assert out.query_id.nunique() == 150
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


def test_more_neighbours_than_are_reranked_first(spark):
    x = np.random.default_rng(5).normal(size=(600, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(frame, k=300).toPandas()
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(600), -s))[:300].tolist()
    assert len(out) == 30 * 300


def test_the_quantised_scan_finds_neighbours_by_itself():
    """In a full block the best 200 of the scan, an eightieth, hold the true neighbours; a random code would find one in eighty."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(ann.INDEX_BLOCK, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book, eta = ann.fit(x[:8000])
    code = ann.encode(x, book, eta)
    rough = ann.scan(ann.tables(x[:100], book), ann.pack(code))
    exact = x[:100] @ x.T
    found = sum(len(set(np.argsort(-rough[i])[:200]) & set(np.argsort(-exact[i])[:20])) for i in range(100))
    assert eta > 1 and found >= 0.9 * 2000
    slack = ann.residual(x, code, book)
    assert (np.abs(rough - exact) <= slack[None, :] + 1e-5).all()


def test_few_neighbours(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(frame).orderBy("rank").collect()] == [(1, 5.0), (2, 0.0)]
    assert ann.nearest(frame.limit(0)).collect() == []


def test_neighbours_of_several_lengths(spark):
    """No vector is dropped for its length: each length is searched by itself."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8 if i % 3 else 16).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(frame, k=3).toPandas()
    assert sorted(out.query_id.unique()) == list(range(0, 300, 20))
    for q, g in out.groupby("query_id"):
        own = [(i, np.dot(v, rows[q][1])) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        assert g.sort_values("rank").vec_id.tolist() == [i for i, _ in sorted(own, key=lambda x: (-x[1], x[0]))[:3]]


def test_texts_that_share_a_passage_each_count(spark):
    """Near copies share the weight of one text; texts that have two thirds in common keep most of theirs, and none is dropped."""
    opening = " ".join(f"w{i}" for i in range(60))
    copied = " ".join(f"c{i}" for i in range(400))
    texts = [opening + " " + " ".join(f"o{i}x{j}" for j in range(30)) for i in range(300)] + [copied + f" end{i % 4}" for i in range(20)] + ["one two"] * 5 + ["", None]
    frame = spark.createDataFrame([(i, t, int(i == 300)) for i, t in enumerate(texts)], "row long, text string, toxic int")
    share = {r["row"]: r["share"] for r in toxicity._shares(toxicity._token_sets(frame)).collect()}
    assert sum(share[i] for i in range(300)) > 200 and share[300] == 1.0 and [round(share[i], 9) for i in range(301, 325)] == [round(1 / 19, 9)] * 19 + [0.2] * 5
    assert 325 not in share and 326 not in share


@pytest.mark.parametrize(
    "text, want",
    [
        ("Intro here. Released under the MIT License.", "MIT-ref"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the Apache\nLicense, Version 2.0.\n\nYou may not use this file except in compliance with the License.", "Apache-2.0"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. "
         "Redistributions in binary form must reproduce the above copyright notice.", "BSD-2-Clause"),
        ("Licensed under CC BY-NC 4.0. Released under the MIT License.", "MIT-ref+CC-BY-NC-4.0"), ("A licence of no known kind.", "UNKNOWN"), ("nothing", "NONE"), ("", "NONE"), (None, "NONE"),
    ],
)
def test_licences(docs_of, text, want):
    assert licenses.scan_licenses(docs_of([(1, text, "s", "en")])).first()["licenses"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under CC BY 4.0.", "CC-BY-4.0"), ("Available under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Distributed under the CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This dataset is CC0.", "CC0-1.0"),
        ("It is dedicated to the public\ndomain.", "CC0-1.0"), ("Available under Creative\nCommons Attribution 4.0.", "CC-BY-4.0"), ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+.", "MIT+Apache-2.0+GPL-2.0-or-later"), ("spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0"),
        ("SPDX-License-Identifier: (BSD-3-Clause AND (LGPL-2.1 OR MPL-2.0))", "BSD-3-Clause+LGPL-2.1+MPL-2.0"),
        ("Code is under the MIT license.", "MIT-ref"), ("Licensed under GPL v3.", "GPL-3.0"), ("Under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"), ("See the GPLv2 or later.", "GPL-2.0-or-later"), ("Es ist mit Sorgfalt gemacht.", "NONE"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. A warranty of our own. The above copyright notice and this permission notice shall be included in all copies.", "MIT"), ("SPDX-License-Identifier: ISC", "ISC"), ("// SPDX-License-Identifier: CC0-1.0\n// SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0+CC0-1.0"),
        ("SPDX-License-Identifier: Nobody-1.0", "UNKNOWN"), ("Copyright 2020 X\nSPDX-License-Identifier: Apache-2.0\nThe mit is no licence here", "Apache-2.0"),
    ],
)
def test_licences_by_every_cue(docs_of, text, want):
    assert licenses.scan_licenses(docs_of([(1, text, "s", "en")])).first()["licenses"] == want


WORDINGS = {
    "denied": "This is not licensed under the MIT license", "version_3_plus": "either version 3 of the License, or (at your option) any later version",
    "version_2_1_plus": "either version 2.1 of the License, or (at your option) any later version", "version_2_plus": "either version 2 of the License, or (at your option) any later version",
    "cc_by_nc_sa_4": "Under CC BY-NC-SA 4.0", "cc_by_nc_nd_4": "CC BY-NC-ND 4.0", "cc_by_nc_4": "Available under CC BY-NC 4.0", "cc_by_sa_4": "Released under the CC-BY-SA 4.0", "cc_by_nd_4": "CC BY-ND 4.0", "cc_by_4": "Distributed under CC BY 4.0",
    "cc_by_sa_3": "CC BY-SA 3.0", "cc_by_3": "Creative Commons Attribution 3.0", "unlicense": "This is free and unencumbered software released into the public domain", "cc_0": "Under CC0",
    "apache_2_comply": "You may not use this file except in compliance with the License", "apache_2_copy": "You may obtain a copy of the License at",
    "apache_2_warranty": "Software distributed under the License is distributed on an AS IS basis", "apache_2_ref": "Released under the Apache License, Version 2.0", "agpl_3": "GNU Affero General Public License",
    "lgpl_3": "GNU Lesser General Public License v3", "lgpl_2_1": "LGPL 2.1", "lgpl_2": "GNU Library General Public License version 2", "lgpl_ref": "GNU Lesser General Public License",
    "gpl_3_plus": "GNU General Public License, either version 3 or any later version", "gpl_2_plus": "GPL v2 or later", "gpl_3_ref": "Under GPLv3", "gpl_2_ref": "GNU General Public License v2", "gpl_ref": "GNU General Public License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit_notice": "The above copyright notice and this permission notice shall be included in all copies",
    "mit_warranty": "The software is provided as is, without warranty of any kind", "mit_ref": "Released under the MIT", "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc_ref": "The ISC License",
    "zlib_warranty": "This software is provided as is, without any express or implied warranty", "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications", "zlib_ref": "zlib license",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd_source": "Redistributions of source code must retain the above copyright notice",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice", "bsd_endorse": "Neither the name of X may be used to endorse or promote products", "bsd_3_ref": "BSD 3-Clause", "bsd_2_ref": "Simplified BSD License", "bsd_ref": "A BSD-style license",
    "mpl_2": "Mozilla Public License v2.0", "epl_2": "EPL-2.0", "epl_1": "Eclipse Public License v1.0", "boost_1": "Boost Software License", "artistic_2": "Artistic License 2.0", "ofl_1_1": "SIL Open Font License", "psf_2": "Python Software Foundation License",
    "spdx_tag": "SPDX License Identifier", "all_rights": "All rights reserved", "copyright": "Copyright X", "unknown": "Free software",
}
# What each of those sentences means by itself, for the brute force below; a licence's own text needs its sentences in order.
ALONE = {
    "cc_by_nc_sa_4": "CC-BY-NC-SA-4.0", "cc_by_nc_nd_4": "CC-BY-NC-ND-4.0", "cc_by_nc_4": "CC-BY-NC-4.0", "cc_by_sa_4": "CC-BY-SA-4.0", "cc_by_nd_4": "CC-BY-ND-4.0", "cc_by_4": "CC-BY-4.0", "cc_by_sa_3": "CC-BY-SA-3.0", "cc_by_3": "CC-BY-3.0",
    "unlicense": "Unlicense", "cc_0": "CC0-1.0", "apache_2_ref": "Apache-2.0", "agpl_3": "AGPL-3.0", "lgpl_3": "LGPL-3.0", "lgpl_2_1": "LGPL-2.1", "lgpl_2": "LGPL-2.0", "lgpl_ref": "LGPL", "gpl_3_plus": "GPL-3.0-or-later", "gpl_2_plus": "GPL-2.0-or-later",
    "gpl_3_ref": "GPL-3.0", "gpl_2_ref": "GPL-2.0", "gpl_ref": "GPL", "mit_ref": "MIT-ref", "isc_grant": "ISC", "isc_ref": "ISC-ref", "zlib_ref": "Zlib-ref", "bsd_3_ref": "BSD-3-Clause-ref", "bsd_2_ref": "BSD-2-Clause-ref", "bsd_ref": "BSD-ref",
    "mpl_2": "MPL-2.0", "epl_2": "EPL-2.0", "epl_1": "EPL-1.0", "boost_1": "BSL-1.0", "artistic_2": "Artistic-2.0", "ofl_1_1": "OFL-1.1", "psf_2": "PSF-2.0", "all_rights": "Proprietary",
}
WHOLE = (
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]), ("MIT", ["mit_grant", "mit_notice"]), ("Zlib", ["zlib_warranty", "zlib_grant"]),
)
# What comes before or behind a whole text belongs to it.
BEFORE, BEHIND = {"MIT": "mit_ref", "Zlib": "zlib_ref", "ISC": "isc_ref"}, {"MIT": ["mit_warranty"], "Apache-2.0": ["apache_2_comply", "apache_2_copy", "apache_2_warranty"], "AGPL-3.0": ["version_3_plus"]}
# A version sentence behind one that names the licence alone.
VERSIONS = (
    ("LGPL-3.0", ["lgpl_ref", "version_3_plus"]), ("LGPL-2.1", ["lgpl_ref", "version_2_1_plus"]), ("LGPL-2.0", ["lgpl_ref", "version_2_plus"]),
    ("GPL-3.0-or-later", ["gpl_ref", "version_3_plus"]), ("GPL-2.0-or-later", ["gpl_ref", "version_2_plus"]),
)


def brute_licences(ids):
    """Set of licences by walking lists: longest texts first, each takes its sentences, with up to three unknown ones between."""
    rest, found = [x for x in ids if x != "copyright"], set()

    def step(at, want):
        """Place of `want` from `at` on behind at most three unknown sentences, or None."""
        for k in range(at, min(at + 4, len(rest))):
            if rest[k] == want:
                return k
            if rest[k] != "unknown":
                return None

    def take(name, items, allowed=None):
        at = 0
        while at < len(rest):
            where, ends = at, []
            for want in items:
                where = step(where, want) if ends else (at if rest[at] == want else None)
                if where is None:
                    break
                ends.append(where)
                where += 1
            if where is None:
                at += 1
                continue
            first, last = ends[0], ends[-1]
            before = BEFORE.get(name)
            if before:
                k = first - 1
                while k >= 0 and rest[k] == "unknown" and first - k <= 3:
                    k -= 1
                if k >= 0 and rest[k] == before:
                    first = k
            for want in BEHIND.get(name, ()):
                k = step(last + 1, want)
                last = last if k is None else k
            rest[first : last + 1] = ["#"]
            found.add(name)
            at = first + 1

    for name, items in WHOLE[:3]:
        take(name, items)
    take("Apache-2.0", ["apache_2_ref"])
    take("Zlib", WHOLE[3][1])
    take("ISC", ["isc_grant"])
    take("AGPL-3.0", ["agpl_3"])
    for name, items in VERSIONS:
        take(name, items)
    found |= {ALONE[x] for x in rest if x in ALONE}
    return found - {"Proprietary"} or found


def test_licences_against_brute_force(docs_of):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(400):
        if rng.random() < 0.6:  # a whole text with something between, before or behind
            name, items = rng.choice([*WHOLE, *VERSIONS, ("AGPL-3.0", ["agpl_3", "version_3_plus"]), ("Apache-2.0", ["apache_2_ref", "apache_2_comply", "apache_2_copy", "apache_2_warranty"])])
            ids = [x for item in items for x in (item, *["unknown"] * rng.choice([0, 0, 1, 3, 4]), *["copyright"] * rng.choice([0, 0, 1]))]
            ids = [rng.choice(list(ALONE)), *ids] if rng.random() < 0.5 else ids
        else:
            ids = [rng.choice(list(WORDINGS)) for _ in range(rng.randrange(1, 6))]
        ids = [x for x in ids if x != "spdx_tag"]
        said = [y for x in ids for y in (WORDINGS[x], *["Nothing of note here"] * rng.choice([0, 1]))]
        rows.append((i, ". ".join(said) + ".", "s", "en"))
        want[i] = (ids, brute_licences(ids))
    for r in licenses.scan_licenses(docs_of(rows)).collect():
        ids, names = want[r["doc_id"]]
        assert r["sentence_ids"] == ",".join(ids) and r["n_unknown"] == ids.count("unknown")
        assert r["licenses"] == ("+".join(n for n in dict.fromkeys(n for n, _ in licenses.RULES) if n in names) or ("UNKNOWN" if set(ids) - {"denied"} else "NONE")), (ids, names)


GPL_HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
BSD_HEADER = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."""


def test_headers_and_common_wordings(docs_of):
    """Texts as they stand in files, with the licences a reader would name; the SQL says the same."""
    want = {
        "licensed under the MIT license or the Apache License, Version 2.0.": "Apache-2.0+MIT-ref", "Dual licensed under GPL v2 or the MPL 2.0.": "GPL-2.0+MPL-2.0",
        BSD_HEADER: "BSD-2-Clause", GPL_HEADER.format(2): "GPL-2.0-or-later", GPL_HEADER.format(3): "GPL-3.0-or-later",
        GPL_HEADER.replace("GNU General", "GNU Lesser General").format("2.1"): "LGPL-2.1", "This is not licensed under the MIT license.": "NONE",
        "This is not licensed under the MIT license. Released under the BSD license.": "BSD-ref", "All rights reserved.": "Proprietary", "Copyright X. All rights reserved. MIT License": "MIT-ref",
    }
    rows = list(enumerate(want))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs_of([(i, t, "s", "en") for i, t in rows])).collect()}
    assert [got[i] for i, _ in rows] == list(want.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert dict(con.execute(f"SELECT doc_id, licenses FROM ({licenses.license_sql()})").fetchall()) == got


@pytest.mark.parametrize("between", [" ", "\n", " \t* "])
def test_every_sentence_passes_the_cue(docs_of, between):
    assert list(WORDINGS) == [name for name, _ in licenses.SENTENCES]
    rows = [(i, between.join(w.split()), "s", "en") for i, w in enumerate(WORDINGS.values())]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(docs_of(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(WORDINGS)


def test_licences_odd_rows(odd, none):
    assert licenses.scan_licenses(odd).count() == 10 and licenses.scan_licenses(none).collect() == []


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best one, then those left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    shift = lambda found, by: [(x + by, y + by, s) for x, y, s in found]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + shift(brute_segments(scores[b:]), b)


def test_segments():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        got, want = toxicity.segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


@pytest.mark.parametrize("n", [30, 3000, 30_000])
def test_calibration_holds_at_every_size(n):
    rng = np.random.default_rng(n)
    toxic = (np.arange(n) % 10 == 0).astype(int)
    evidence = np.where(toxic, rng.uniform(4, 60, n) * (rng.random(n) > 0.05), rng.uniform(0, 3, n) * (rng.random(n) < 0.03))
    model = toxicity.Model({}, 0.0, -0.1)
    model.calibrate(evidence.tolist(), toxic.tolist())
    score = 1 / (1 + np.exp(-(model.at_none + model.slope * np.minimum(evidence, 60))))
    assert np.isfinite(score).all() and (score[toxic == 0] < 0.7).all() and (score[toxic == 1] >= 0.7).mean() > 0.8


def test_toxicity_is_learned(spark, docs_of, odd, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["slur", "vile", "scum"])
        rows.append((i, " ".join(w), "s", "en"))
        labels.append((i, int(bad)))
    docs = docs_of(rows)
    frame = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, frame)
    assert {"slur", "vile", "scum"} <= set(model.log_odds)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model, spans=True).collect()}
    assert all(out[i]["predicted"] == t and out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, t in labels)
    assert all(bool(out[i]["passages"]) == bool(t) for i, t in labels)
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == 10 and all(0 <= r["score"] < 0.7 for r in scored)
    assert toxicity.score_documents(none, model).collect() == []
    assert toxicity.score_documents(odd, toxicity.learn(odd, frame.limit(0))).count() == 10


def test_language(docs_of, odd, none):
    rng = random.Random(6)
    parts = {"aa": ["tion", "ing", "the", "whe"], "bb": ["eau", "eux", "que", "les"], "cc": ["sch", "ung", "der", "heit"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), "s", lang))
    docs = docs_of(rows)
    model = langid.learn(docs)
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(out[i]["lang_pred"] == g for i, _, _, g in rows) and all(0 <= r["score"] <= 1 for r in out.values())
    odd_out = langid.predict(odd, model).collect()
    assert {r["lang_pred"] for r in odd_out if r["doc_id"] in (1, 2, 8)} == {"und"} and len(odd_out) == 10
    assert langid.predict(none, model).collect() == []
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}


def test_language_by_brute_force_cosine(docs_of):
    """Vectors made with dictionaries, idf from learnable rows alone; the nearest of the model's centroids by plain cosine."""
    import math
    import re
    from collections import Counter

    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(12)), "s", g) for i in range(150) for g, p in [rng.choice([("aa", ["tion", "ing", "é"]), ("bb", ["eau", "que", "ing"])])]]
    rows += [(200, None, "s", "aa"), (201, "12 34", "s", "bb"), (202, "tion", "s", None)]
    model = langid.learn(docs_of(rows))

    def trigrams(text):
        letters = re.sub(r"[^a-z\x80-\xff]+", " ", f" {(text or '').lower()} ".encode().decode("latin-1"))
        data = letters.encode("latin-1")
        code = lambda a, b, c: ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 20
        return Counter(code(*data[k : k + 3]) for k in range(len(data) - 2))

    known = [t for i, t, _, g in rows if g and zlib.crc32(str(i).encode()) % 3 != 1]
    df = Counter(d for t in known for d in trigrams(t))
    assert np.allclose(model["idf"], [math.log((1 + len(known)) / (1 + df[d])) + 0.1 for d in range(langid.DIMS)], atol=1e-5)
    for r in langid.predict(docs_of(rows), model).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = {d: math.sqrt(n) * float(model["idf"][d]) for d, n in trigrams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model["centroids"]]
        assert abs(r["score"] - max(cos)) < 1e-4 and cos[model["langs"].index(r["lang_pred"])] > max(cos) - 1e-4 or r["lang_pred"] == model["langs"][int(np.argmax(cos))]


def test_held_out_rows_do_not_change_the_language_model(docs_of):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice(["tion", "eau", "sch"]) for _ in range(3)) for _ in range(9))
    rows = [(i, text(), "s", "aa" if i % 2 else "bb") for i in range(90)]
    more = [(i, text(), "s", "cc") for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 3 == 1] + [(300, text(), "s", None), (None, text(), "s", "dd")]
    a, b = langid.learn(docs_of(rows)), langid.learn(docs_of(rows + more))
    assert a["langs"] == b["langs"] and (a["idf"] == b["idf"]).all() and np.allclose(a["centroids"], b["centroids"], atol=1e-6)


def test_evidence_by_brute_force():
    """The least chance over r, computed anew from the segments' expectations, every segment counted."""
    import math

    model = toxicity.Model({"bad": 4.0, "vile": 3.0}, 0.001, -0.3)
    rng = random.Random(10)
    for n in (0, 1, 5, 40, 6000):
        text = " ".join(rng.choice(["bad", "vile", *["fine"] * 60]) for _ in range(n))
        scores = [{"bad": 4.0, "vile": 3.0}.get(w, -0.3) for w in text.split()]
        excess = sorted((model.scale * s - math.log(model.k * len(scores)) for *_, s in toxicity.segments(scores)), reverse=True)
        best, total = 0.0, 0.0
        for r, x in enumerate(excess, 1):
            total += x
            if total <= 0:
                break
            tail = -math.log(-math.expm1(-math.exp(-total))) if r == 1 and total < 30 else total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, tail)
        assert math.isclose(model.evidence(text), best, rel_tol=1e-9, abs_tol=1e-9) and (len(excess) > 64) == (n == 6000)
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-min(60, model.at_none + model.slope * best))))


def test_a_text_counts_alike_in_any_place():
    texts = ["the  cat", "é", "", " a", None, "the cat", "b" * 200, "a"] * 40
    alone = np.concatenate([langid.counts([t]) for t in texts])
    assert (langid.counts(texts) == alone).all() and (alone[1::8].sum(1) > 0).all() and (alone[7::8].sum(1) == 1).all()
    assert (langid.counts(texts[::-1])[::-1] == alone).all()


def compare_mix(frame, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    want = sorted(con.execute(mixing.MIX_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.mix_sources(frame, range_rows=40).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))
    return got


def test_mix(docs_of, none):
    rng = random.Random(7)
    rows = [(i, " ".join("x" for _ in range(rng.randrange(0, 30))), rng.choice(["a"] * 20 + ["b", "c", "dé", None, "e" * 9, "Z"]), "en") for i in range(800)]
    rows += [(2000, None, "n", "en"), (2001, "", "m", "en")]
    got = compare_mix(docs_of(rows), rows)
    assert all(0 <= taken <= 3 * size for _, size, _, _, taken in got)
    assert mixing.mix_sources(none).collect() == []


def test_mix_odd_rows(odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r["doc_id"] in (1, 2, 8)} == {0}


def test_pipeline(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))) + (" vile scum slur" if i % 6 == 0 else ""), f"s{i % 4}", "en") for i in range(300)]
    rows += [(300 + i, rows[i + 1][1], "s1", "en") for i in range(0, 40, 6)] + [(400, None, "s1", None), (401, "", None, "en")]
    docs_of(rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {i for i, *_ in rows if i >= 300 or i % 6}
    unique = corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path))
    assert {r["doc_id"] for r in unique.collect()} == {i for i in ids if i < 300 or i >= 400}
    assert clean.columns == unique.columns == list(corpus_pipeline.COLUMNS)
    cut = corpus_pipeline.cut_repeats(spark, docs, str(tmp_path))
    assert cut.count() == len(rows)
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path)).toPandas()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    n = mixed.assign(n=mixed.text.str.split().str.len()).groupby("doc_id").n.sum().to_dict()
    assert n == {i: t for i, t in taken.items() if t}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
