"""License scans: planted notices, edited texts, and the alignment against brute force."""

import random

from lorestack.llm import licenses as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1) if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_common_subsequence_and_exact_on_unique_words():
    rng = random.Random(1)
    for _ in range(200):
        a = [str(rng.randrange(30)).encode() for _ in range(rng.randint(0, 25))]
        b = [w for w in a if rng.random() > 0.2]
        b.insert(rng.randint(0, len(b)), b"new")
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got)) and all(p[1] < q[1] for p, q in zip(got, got[1:]))
        if len(set(a)) == len(a):
            assert len(got) == lcs(a, b)
    shuffled = list(range(12))
    rng.shuffle(shuffled)
    a, b = [b"%d" % i for i in range(12)], [b"%d" % i for i in shuffled]
    assert len(L.align(a, b)) <= lcs(a, b)


def test_scan(spark):
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500)
    edited = mit.replace("free of charge, ", "").replace("furnished", "given").replace("publish, ", "")
    rows = [
        (1, "é text.\nReleased under the MIT License.\nmore"),
        (2, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        (3, "x " * 20_000 + mit.upper() + " y"),
        (4, edited),
        (5, mit[: len(mit) // 2]),
        (6, "the license of this work is under the sun"),
        (7, None),
        (8, ""),
        (9, "Licensed under CC BY 4.0"),
        (10, "THIS WORK IS LICENSED!! UNDER THE GNU GENERAL PUBLIC LICENSE,*** VERSION 3."),
        (1, "é text.\nReleased under the MIT License.\nmore"),
        (None, "Licensed under the Apache License, Version 2.0."),
    ]
    docs = spark.createDataFrame([(i, t, "l", 0) for i, t in rows], "doc_id long, text string, license string, start int").repartition(3)
    got = L.scan_licenses(docs).collect()
    texts = dict(rows)
    assert sorted((r.doc_id or 0, r.license) for r in got) == sorted([(1, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0"), (2, "CC-BY-NC-4.0"), (3, "MIT"), (4, "MIT"), (9, "CC-BY-4.0"), (10, "GPL-3.0"), (0, "Apache-2.0")])
    for r in got:
        span = texts[r.doc_id][r.start : r.end].lower()
        assert span.split()[0] in ("released", "licensed", "permission", "this") and 0.8 <= r.coverage <= 1
    assert [texts[1][r.start : r.end] for r in got if r.doc_id == 1][0] == "Released under the MIT License"
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_relatives_are_told_apart(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [
        ("Licensed under the BSD License", None),
        ("licensed under the terms of the license", None),
        ("Licensed under the terms of the MIT License.", "MIT"),
        ("SPDX-License-Identifier: MIT-0", None),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This book is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("released under the GNU General Public License, version 2.", "GPL-2.0"),
        ("released under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("released under the GNU General Public License, version 2.7", None),
        (gnu.format("General Public License", "2"), "GPL-2.0"),
        (gnu.format("General Public License", "3"), "GPL-3.0"),
        (gnu.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
        (gnu.format("Affero General Public License", "3"), "AGPL-3.0"),
        (gnu.format("Sometimes General Public License", "3"), None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Released under CC0 1.0 Universal.", "CC0-1.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("Available under the Eclipse Public License v2.0", "EPL-2.0"),
        ("Licensed under the zlib License", "Zlib"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in L.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert [(t, got.get(i)) for i, (t, _) in enumerate(rows)] == [(t, [n] if n else None) for t, n in rows]


def test_each_template_is_found_as_itself():
    for name, text in L.TEMPLATES:
        assert L.Template(name, text, 0.8).named(L._WORD.findall(text.lower().encode())) or len(text.split()) <= L.NOTICE
    assert {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "CC-BY-ND-4.0", "EPL-2.0", "BSL-1.0", "Zlib"} <= {n for n, _ in L.TEMPLATES}


def scanner(templates, coverage=0.8):
    known = [L.Template(n, t, coverage) for n, t in templates]
    guards = sorted({g for t in known for g in t.guard})
    return lambda text: L.scan_text(text.encode(), known, {}, guards, coverage)


def test_scan_against_brute_force():
    """Edited copies of made-up texts inside other words: found where the best stretch has the coverage on both sides."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    templates = [(f"T{i}", " ".join(word() for _ in range(rng.randint(40, 120)))) for i in range(4)]
    scan = scanner(templates)
    for _ in range(120):
        name, text = rng.choice(templates)
        kept, edits = [], rng.choice((0.02, 0.05, 0.3, 0.5))
        for w in text.split():
            if rng.random() >= edits / 2:
                kept.append(w)
            if rng.random() < edits / 2:
                kept.append(word())
        lead, tail = ([word() for _ in range(rng.randint(0, 60))] for _ in range(2))
        got = scan(" ".join(lead + kept + tail))
        common = lcs([w.encode() for w in text.split()], [w.encode() for w in kept])
        share = common / max(len(text.split()), len(kept))
        if share >= 0.85:
            assert [g[0] for g in got] == [name] and abs(got[0][4] - share) < 0.06, (edits, share, got)
        if share < 0.75:
            assert not got, (edits, share, got)


def test_whole_texts_and_changed_beginnings(spark):
    whole = dict((n, t) for n, t in L.TEMPLATES if len(t) > 5000)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GFDL-1.3"} <= set(whole)
    rng = random.Random(2)
    cut = {n: t.split() for n, t in whole.items()}
    rows = [(n, "Intro. " + t + " end") for n, t in whole.items()]
    rows += [(n, "Changed first words " + " ".join(w if rng.random() > 0.03 else "zzz" for w in ws[8:])) for n, ws in cut.items()]
    rows += [(n, " ".join(ws[: len(ws) // 2] + ["inserted"] * 60 + ws[len(ws) // 2 :])) for n, ws in cut.items()]
    rows += [(None, " ".join(x for w in ws for x in (w, "other"))) for n, ws in cut.items() if n != "LGPL-3.0"]  # every second word is not the license's
    rows += [(None, " ".join(ws[: len(ws) // 3])) for ws in cut.values()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in L.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append((r.matched, r.license))
    for i, (name, _) in enumerate(rows):
        matched, best = max(got.get(i, [(0, None)]))
        assert best == name if name else matched < 400, (i, name, got.get(i))


def test_two_copies_are_two_findings():
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500)
    scan = scanner([("MIT", mit)])
    assert [g[0] for g in scan(f"{mit} {mit}")] == ["MIT", "MIT"]
    assert [g[0] for g in scan(f"{mit} {'between words ' * 400} {mit[30:]}")] == ["MIT", "MIT"]
    assert L.best_stretch([(0, 0), (50, 60), (51, 61), (52, 62), (54, 63)]) == (1, 4)


def test_short_notices_align():
    found = L.Notices()
    scan = lambda text: [(r[0], text[r[1] : r[2]]) for r in L.scan_text(text.encode(), [], found, [b"licen", b"under", b"spdx"], 0.8)]
    cases = {
        "MIT licensed": [("MIT", "MIT licensed")],
        "License: MIT": [("MIT", "License: MIT")],
        "Licensed under the MIT licence": [("MIT", "Licensed under the MIT licence")],
        "Dual licensed under MIT and Apache-2.0": [("MIT", "licensed under MIT"), ("Apache-2.0", "Apache-2.0")],
        "Apache License 2.0": [("Apache-2.0", "Apache License 2.0")],
        "SPDX-License-Identifier: GPL-3.0-or-later": [("GPL-3.0", "License-Identifier: GPL-3.0")],
        "Licensed under GPLv3": [("GPL-3.0", "Licensed under GPLv3")],
        "available under the MPL 2.0 or the LGPL v2.1": [("MPL-2.0", "available under the MPL 2.0"), ("LGPL-2.1", "LGPL v2.1")],
        "Creative Commons Attribution-ShareAlike 4.0 International License": [("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")],
        "It is not free. Licensed under the MIT License": [("MIT", "Licensed under the MIT License")],
    }
    assert {t: scan(t) for t in cases} == cases
    none = ["Not licensed under the MIT License", "never released under the ISC license", "Licensed under the Eclipse Public License", "Released under the BSD License", "We moved to MIT. The license came later", "He got a driver license at MIT", "SPDX-License-Identifier: MIT-0", "das ist mit der Lizenz", "licensed under the Apache license 1.1", "released MIT", ""]
    assert [t for t in none if scan(t)] == []


def test_every_notice_is_found_as_itself_in_other_words():
    found = L.Notices()
    for name, text in L.NOTICE_TEXTS:
        for around in (f"Words before. {text}. Words after", f"x, {text}, y", text.upper()):
            got = L.scan_text(around.encode(), [], found, [b"licen"], 0.8)
            assert [g[0] for g in got] == [name], (name, around, got)
