"""License scans by patience alignment against license texts and notices.

Runs of three words that a template has once show where in a text it may stand. There both are aligned: common ends first,
then the words that occur once in both are anchors, the longest increasing subsequence of them is kept, and the gaps
between anchors are aligned in the same way. Of the alignment the stretch counts in which matched words most exceed the
words that either side has alone. Coverage is two-sided: the share of the template's words that found their place, or of
the stretch's words in the text, whichever is less, so that inserted words count like missing ones. The words that name
the license and its version must be there without gaps.

Notices of a sentence are aligned in the same way, around each place where the text has the word that tells a license from
others. In them the words that name it and its version are all obligatory, in order and with nothing between but words such
as "license" and "version", and a word of licensing must be joined to them; the other words of a notice need not be there.
A notice that is denied ("not licensed under ...") is none. A name without the version that it needs (BSD, EPL) names no
license.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.pieces import blocks

_DISCLAIM = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of version {1} of the GNU {0} as published by the Free Software Foundation"
_LATER = ", or (at your option) any later version."
_GNU_KINDS = [("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"), ("LGPL", "Library General Public License", "2.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"), ("AGPL", "Affero General Public License", "3.0")]



#: Names of licenses as notices give them, by SPDX identifier; of those with versions the identifier has "{}".
NAMES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("MIT", ("mit",), ()),
    ("ISC", ("isc",), ()),
    ("Zlib", ("zlib",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("Apache-{}", ("apache",), ("2.0",)),
    ("GPL-{}", ("gnu general public", "gnu gpl", "gpl"), ("2.0", "3.0")),
    ("LGPL-{}", ("gnu library general public",), ("2.0",)),
    ("LGPL-{}", ("gnu lesser general public",), ("2.1", "3.0")),
    ("LGPL-{}", ("gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    ("AGPL-{}", ("gnu affero general public", "gnu agpl", "agpl"), ("3.0",)),
    ("MPL-{}", ("mozilla public", "mpl"), ("1.1", "2.0")),
    ("EPL-{}", ("eclipse public", "epl"), ("1.0", "2.0")),
    ("BSL-{}", ("boost software", "bsl"), ("1.0",)),
    ("BUSL-{}", ("business source",), ("1.1",)),
    ("BSD-2-Clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd"), ()),
    ("BSD-3-Clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"), ()),
    ("BSD-4-Clause", ("bsd 4 clause", "4 clause bsd", "original bsd"), ()),
    ("CC0-1.0", ("cc 0 1.0", "cc 0 universal", "cc 0", "creative commons zero"), ()),
    *((f"CC-BY{short}-{{}}", (f"cc by{short.lower().replace('-', ' ')}", f"creative commons attribution {long}".strip()), ("1.0", "2.0", "2.5", "3.0", "4.0")) for short, long in (("", ""), ("-NC", "noncommercial"), ("-SA", "sharealike"), ("-ND", "noderivatives"), ("-ND", "noderivs"), ("-NC-SA", "noncommercial sharealike"), ("-NC-ND", "noncommercial noderivatives"), ("-NC-ND", "noncommercial noderivs"))),
]
#: Words of licensing; those of publishing, which need "under"; words that may stand between others, or before a last "license"; denials.
LICENSING = {b"license", b"licensed", b"licence", b"licenced", b"licenses", b"licences", b"licensing", b"spdx"}
PUBLISHING = {b"released", b"distributed", b"published", b"available"}
BETWEEN = {b"the", b"a", b"an", b"under", b"of", b"terms", b"conditions", b"and", b"or", b"version", b"v", b"this", b"work", b"is", b"identifier", b"international", b"universal", b"unported", b"commons", b"creative", b"only", b"later"}
AFTER = {b"international", b"universal", b"unported", b"only", b"or", b"later"}
DENIALS = {b"not", b"never", b"non", b"isn", b"aren", b"without"}


def notices() -> Iterator[tuple[str, str]]:
    """(SPDX identifier, text) of the one-sentence notices, one for each name and version."""
    for spdx, names, versions in NAMES:
        for name in names:
            for version in versions or ("",):
                yield spdx.format(version), f"This work is licensed under the terms of the {name} license{' version ' + version if version else ''}"


#: Public license texts and usual notices, by SPDX identifier. Several templates may name one license.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIM),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", _BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{short}-{v}", text.format(long, v.removesuffix(".0")) + end) for short, long, v in _GNU_KINDS for text in (_GNU, _ONLY) for end in ((_LATER, "") if text is _GNU else ("",))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # Whole texts of licenses, one file each, named by the identifier.
    *sorted((f.name.removesuffix(".txt"), f.read_text("utf-8", "replace")) for f in (files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")),
    *notices(),
]
#: Words that the long texts of a license must hold one after another: what tells it from its relatives.
NAMING: dict[str, list[str]] = {
    "MIT": ["shall be included in all copies"],
    "BSD-3-Clause": ["endorse or promote products"],
    "BSD-4-Clause": ["All advertising materials", "endorse or promote products"],
    "Apache-2.0": ["Apache License", "Version 2.0"],
    "MPL-1.1": ["Mozilla Public License", "Version 1.1"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    **{f"{short}-{v}": [f"GNU {long}", f"version {v.removesuffix('.0')}"] for short, long, v in _GNU_KINDS},
}
NOTICE_TEXTS = list(notices())
#: Words of the longest notice.
NOTICE = max(len(text.split()) for _, text in NOTICE_TEXTS)
_WORD = re.compile(rb"[a-z0-9]+")
_GOES_ON = re.compile(rb"\.[0-9]|-(?!only|or-later)[a-z0-9]")
_SHORT_WORD = re.compile(rb"[a-z]+?(?=v[0-9])|v(?=[0-9])|[a-z]+|[0-9]+")
_BREAK = re.compile(rb"\.\s|\n\s*\n")
_SCHEMA = "doc_id long, license string, start long, end long, matched int, coverage double"


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places (in a, in b) that patience alignment matches, both increasing."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, j, k, m = waiting.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: n for n, w in enumerate(b[k:m], k)}
        anchors = [(n, place[w]) for n, w in enumerate(a[i:j], i) if in_a[w] == 1 and in_b[w] == 1]
        tails: list[int] = []  # smallest last place in b of an increasing run of each length
        last: list[int] = []
        back: list[int] = []
        for at, (_, y) in enumerate(anchors):
            n = bisect_left(tails, y)
            tails[n : n + 1] = [y]
            last[n : n + 1] = [at]
            back.append(last[n - 1] if n else -1)
        chain, at = [], last[-1] if last else -1
        while at >= 0:
            chain.append(anchors[at])
            at = back[at]
        x, y = i, k
        for p, q in reversed(chain):
            out.append((p, q))
            waiting.append((x, p, y, q))
            x, y = p + 1, q + 1
        if chain:
            waiting.append((x, j, y, m))
    return sorted(out)


class Template:
    """A license text, its words, and words of which a text with ``coverage`` of them must hold one."""

    def __init__(self, name: str, text: str, coverage: float):
        self.name = name
        self.words = _WORD.findall(text.lower().encode())
        self.naming = [b" " + b" ".join(_WORD.findall(x.lower().encode())) + b" " for x in NAMING.get(name, [])]
        self.distinct = set(self.words)
        count = Counter(self.words)
        spare, self.guard = (1 - coverage) * len(self.words), []
        for w in sorted(count, key=lambda w: (len(w) < 6, -count[w], -len(w), w)):
            self.guard.append(w)
            spare -= count[w]
            if spare < 0:
                break
        missing = int((1 - coverage) * len(self.words) + 1e-9)
        self.least = max(1, len(self.distinct) - missing)  # distinct words that such a text must hold
        runs = list(zip(self.words, self.words[1:], self.words[2:]))
        often = Counter(runs)
        self.anchors = {r: i for i, r in enumerate(runs) if often[r] == 1}

    def named(self, words: list[bytes]) -> bool:
        """Whether the words hold those that name the license."""
        text = b" " + b" ".join(words) + b" "
        return all(x in text for x in self.naming)


class Notice:
    """A one-sentence notice: its words, and the places of those that must be there."""

    def __init__(self, spdx: str, name: str, version: str):
        self.name = spdx
        named, number = _SHORT_WORD.findall(name.encode()), _SHORT_WORD.findall(version.encode())
        lead = [b"this", b"work", b"is", b"license", b"under", b"the", b"terms", b"of", b"the"]
        self.words = [*lead, *named, b"license", *([b"version", *number] if number else [])]
        self.must = [*range(len(lead), len(lead) + len(named)), *range(len(self.words) - len(number), len(self.words))]
        self.anchor = max(named, key=lambda w: (w not in BETWEEN, len(w)))


class Notices:
    """Notices by the word that each is looked for at."""

    def __init__(self, names=NAMES):
        self.at: dict[bytes, list[Notice]] = {}
        self.naming: set[bytes] = set()
        for spdx, of, versions in names:
            for name in of:
                for version in dict.fromkeys(x for v in versions for x in (v, v.removesuffix(".0"))) or ("",):
                    full = next((v for v in versions if version in (v, v.removesuffix(".0"))), "")
                    notice = Notice(spdx.format(full), name, version)
                    self.at.setdefault(notice.anchor, []).append(notice)
                    self.naming |= {notice.words[i] for i in notice.must}

    def places(self, low: bytes) -> Iterator[tuple[int, int, str, int]]:
        """(start, end, license, words matched) of the notices in a text, in bytes; of those at one place the longest name."""
        spans = [m.span() for m in _SHORT_WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        plain = [b"license" if w in LICENSING else w for w in words]
        for i, w in enumerate(words):
            if w in self.at and any(x == b"license" or x in PUBLISHING for x in plain[max(0, i - 14) : i + 8]):
                begin, end = i, i + 1  # of the same sentence, to the next place of the word
                while begin > max(0, i - 14) and words[begin - 1] != w and not _BREAK.search(low, spans[begin - 1][1], spans[begin][0]):
                    begin -= 1
                while end < min(len(words), i + 14) and words[end] != w and not _BREAK.search(low, spans[end - 1][1], spans[end][0]):
                    end += 1
                found = [f for n in self.at[w] if (f := self._found(n, plain, spans, low, begin, i, end))]
                if found:
                    yield max(found, key=lambda f: (f[3], f[0]))

    def _found(self, notice: Notice, plain: list[bytes], spans: list[tuple[int, int]], low: bytes, begin: int, anchor: int, end: int) -> tuple[int, int, str, int] | None:
        # The word looked for is an anchor as it stands; either side is aligned for itself.
        k = next(j for j in notice.must if notice.words[j] == notice.anchor)
        before = align(notice.words[:k][::-1], [b"license" if w in PUBLISHING else w for w in plain[begin:anchor]][::-1])
        after = align(notice.words[k + 1 :], plain[anchor + 1 : end])
        at = {k - 1 - x: anchor - 1 - y for x, y in before} | {k: anchor} | {k + 1 + x: anchor + 1 + y for x, y in after}
        if any(j not in at for j in notice.must):
            return None
        own = sorted(at[j] for j in notice.must)
        free = BETWEEN | {b"license"}
        if own != [at[j] for j in notice.must] or any(plain[p] not in free for p in range(own[0], own[-1]) if p not in own) or _GOES_ON.match(low, spans[own[-1]][1]):
            return None
        first, last = own[0], own[-1]
        joined = any(plain[p] == b"license" for p in range(first, last + 1))
        q = last + 1
        while q < min(len(plain), last + 4) and plain[q] in AFTER and not _BREAK.search(low, spans[q - 1][1], spans[q][0]):
            q += 1
        if q < len(plain) and plain[q] == b"license" and not _BREAK.search(low, spans[q - 1][1], spans[q][0]):
            last, joined = q, True
        p, under, other = first - 1, False, False
        while p >= begin and (plain[p] in free or plain[p] in PUBLISHING or plain[p] in self.naming or plain[p].isdigit()) and not _BREAK.search(low, spans[p][1], spans[p + 1][0]):
            under, other = under or plain[p] == b"under", other or plain[p] in (b"and", b"or") or plain[p].isdigit() or plain[p] in self.naming - BETWEEN
            if plain[p] == b"license" or (plain[p] in PUBLISHING and under):
                first, joined = first if other else p, True  # a word that another license stands next to is shared with it
                break
            p -= 1
        if joined and first >= 3 and plain[first - 3 : first] == [b"this", b"work", b"is"]:
            first -= 3
        begun = p if joined and p >= begin and plain[p] in PUBLISHING | {b"license"} else first
        if not joined or any(plain[q] in DENIALS and not _BREAK.search(low, spans[q][1], spans[begun][0]) for q in range(max(0, begun - 3), begun)):
            return None
        return spans[first][0], spans[last][1], notice.name, len(at)


def windows(template: Template, words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of the text that may hold the template once each: where its anchors stand about as far apart as in it."""
    n = len(template.words)
    hits = [(i, at) for i, r in enumerate(zip(words, words[1:], words[2:])) if (at := template.anchors.get(r)) is not None]
    groups: list[list[tuple[int, int]]] = []
    for i, at in hits:
        last = groups[-1][-1] if groups else None
        if last is None or i - last[0] > n // 2 + 20 or at < last[1] - n // 2:  # too far from the last, or begun again
            groups.append([])
        groups[-1].append((i, at))
    slack, end = n // 4 + 4, 0
    for k, group in enumerate(groups):
        (i, at), (j, to) = group[0], group[-1]
        begin = max(end, i - at - slack)
        end = min(groups[k + 1][0][0] if k + 1 < len(groups) else len(words), j + (n - to) + slack)
        yield begin, end


def best_stretch(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """The part of an alignment in which matches most exceed the words between them, on either side: first and last pair."""
    best, found, total, begin = 0, (0, 0), 0, 0
    for k, (x, y) in enumerate(pairs):
        gap = (x - pairs[k - 1][0] - 1) + (y - pairs[k - 1][1] - 1) if k else 0
        if k == 0 or total - gap <= 0:
            total, begin = 0, k
        else:
            total -= gap
        total += 1
        if total >= best:
            best, found = total, (begin, k)
    return found


def places(template: Template, words: list[bytes], coverage: float) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, words matched) of the template's occurrences, none overlapping."""
    n = len(template.words)
    for begin, end in windows(template, words):
        pairs = align(template.words, words[begin:end])
        if len(pairs) < coverage * n:
            continue
        a, b = best_stretch(pairs)
        matched, first, last = b - a + 1, begin + pairs[a][1], begin + pairs[b][1]
        if matched >= coverage * max(n, last - first + 1) and template.named(words[first : last + 1]):
            yield first, last, matched


def scan_text(text: bytes, templates: list[Template], notices: Notices | dict, guards: list[bytes], coverage: float) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end, matched, coverage) in characters; of findings that overlap the best covered, then the longest."""
    low = text.lower()
    if not any(g in low for g in guards):
        return []
    spans = [m.span() for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    there = set(words)
    found = [(-1.0, -k, a, b, name) for a, b, name, k in (notices.places(low) if notices else ())]
    for t in templates:
        if len(there) >= t.least and len(t.distinct & there) >= t.least:
            found += [(-k / max(len(t.words), b - a + 1), -k, spans[a][0], spans[b][1], t.name) for a, b, k in places(t, words, coverage)]
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[1] * -f[0], f)):  # most words matched, weighed by coverage
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    chars = lambda at: len(text[:at].decode("utf-8", "replace"))
    return [(name, chars(a), chars(b), -k, -c) for c, k, a, b, name in sorted(kept, key=lambda f: f[2])]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license found in a whole text: doc_id, license, start, end (characters), matched words, coverage.

    Words are runs of a-z and 0-9 in lower case. ``coverage`` is that of license texts, in which the words that ``NAMING``
    gives stand without gaps; of a notice the words that name the license are all there, so its coverage is 1. A denied
    notice is none, nor is a name without the version that it needs. Null and empty texts have none; a license that a text holds twice is found
    twice; repeated rows give repeated findings; a null identifier is carried. Other columns are not read. An empty table
    gives an empty result. Everything is on the map side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = {text for _, text in NOTICE_TEXTS}
        known = [Template(name, text, coverage) for name, text in templates if text not in short]
        notices = Notices() if any(text in short for _, text in templates) else {}
        guards = sorted({g for t in known for g in t.guard} | ({b"licen", b"under", b"spdx"} if notices else set()), key=lambda g: (-len(g), g))
        guards = [g for g in guards if not any(h in g for h in guards if h != g)]  # a word with another inside adds nothing
        for block in blocks(batches, "text", 8 << 20):
            rows = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), strict=True):
                rows += [(doc, *f) for f in scan_text(text or b"", known, notices, guards, coverage)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "start", "end", "matched", "coverage"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op5_license_scans(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` against the templates."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
