"""Licence families told apart, SPDX expressions, wrapped full texts, and the whole choice against a plain computation."""

import math
import textwrap
from collections import Counter

import pytest

from rankloom.llm import licenses as L

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CASES = [
    ("\n".join("# " + x for x in textwrap.wrap(_GNU.format("Affero General Public License", "3"), 70)), "AGPL-3.0"),
    ("\n".join(" * " + x for x in textwrap.wrap(_GNU.format("Lesser General Public License", "2.1"), 70)), "LGPL-2.1"),
    (_GNU.format("General Public License", "3"), "GPL-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    ("SPDX-License-Identifier: MIT-0", "MIT-0"),
    ("Licensed under the MIT No Attribution License", "MIT-0"),
    ("Licensed under the MIT License", "MIT"),
    ("Licensed under the BSD 4-Clause License", "BSD-4-Clause"),
    ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("Made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) and mit */", "(GPL-2.0 WITH Linux-syscall-note) AND mit"),
    ("SPDX-License-Identifier: Custom-1.0", "Custom-1.0"),
    ("nothing here", None),
]


@pytest.fixture(scope="module")
def known():
    return L.Templates(L.TEMPLATES), L.Templates(L.HEADERS), L.Templates(L.TEXTS)


@pytest.mark.parametrize(("text", "want"), CASES)
def test_families_and_expressions(known, text, want):
    vectors, headers, whole = known
    assert L.own_license(text, vectors, headers=headers, whole=whole)[0] == want


@pytest.mark.parametrize("name", sorted(L.TEXTS))
def test_wrapped_full_texts(known, name):
    vectors, headers, whole = known
    for width, prefix in ((70, ""), (60, " * "), (78, "# ")):
        wrapped = "\n".join(prefix + x for x in textwrap.wrap(L.TEXTS[name][0], width))
        assert "\n" in wrapped and L.own_license("Copyright 2020 A\n\n" + wrapped, vectors, headers=headers, whole=whole)[0] == name


@pytest.mark.parametrize("text", ["SPDX-License-Identifier:", "SPDX-License-Identifier: OR", "SPDX-License-Identifier: (MIT"])
def test_no_valid_expression(text):
    assert L.spdx(text) is None


def plain_best(templates, text_words):
    """The nearest template by dense vectors, versions and marks checked one by one."""
    lists = [(n, L.words(t)) for n in sorted(templates) for t in templates[n]]
    df = Counter(w for _, ws in lists for w in set(ws))
    weigh = lambda ws: {w: c * ((math.log((1 + len(lists)) / (1 + df[w])) + 1) if w in df else math.log(1 + len(lists)) + 1) for w, c in Counter(ws).items()}
    mine, best = weigh(text_words), (0.0, None)
    row = f" {' '.join(text_words)} "
    for name, ws in lists:
        other = weigh(ws)
        cosine = sum(v * other.get(w, 0) for w, v in mine.items()) / math.sqrt(sum(v * v for v in mine.values()) * sum(v * v for v in other.values()))
        version = name.rpartition("-")[2] if "." in name and name != "CC0-1.0" else None
        if version and not any(w.lstrip("abcdefghijklmnopqrstuvwxyz") in {version, version.removesuffix(".0")} for w in mine):
            continue
        wrong = False
        for family, marks in L.FAMILIES.items():
            if name.startswith(family):
                have = {m for m in marks if any(f" {x} " in row for x in L.MARKS[m])}
                own = {m for m in marks if any(f" {x} " in f" {' '.join(L.words(name))} " for x in L.MARKS[m])}
                wrong |= have != own and not (name.startswith(("BSD", "0BSD")) and not have)
        if not wrong and cosine > 0 and round(cosine, 9) > best[0]:
            best = (round(cosine, 9), name)
    return best


def test_choice_against_plain_computation(known):
    texts = [t for ts in L.TEMPLATES.values() for t in ts] + [c for c, _ in CASES] + ["the licence of version 3 is lesser and affero", "BSD license 3 clause and 4 clause", "Creative Commons ShareAlike NonCommercial 4.0", "MIT 0 licence", "GNU 2.1 general public"]
    for text in texts:
        got, want = known[0].best(L.words(text), marked=True), plain_best(L.TEMPLATES, L.words(text))
        assert got[1] == want[1] and got[0] == pytest.approx(want[0], abs=1e-8), text
