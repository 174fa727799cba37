"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories (operator 9).

Each line that mentions a licence is a segment, alone, by sentence and with the line after it (titles go over two
lines); a line over 2 * WINDOW words gives wide and narrow windows of words around each mention instead. Its sparse TF-IDF vector is
compared with those of the templates. Paragraphs, as headers are wrapped over lines, are compared with common headers and
grants alike, and a whole file of a licence's size with the full texts of short licences, at a threshold of its own. The best
one at or above the threshold is the file's own licence; a whole text goes before paragraphs and lines. A template counts only if its
version is among the words. Files that are licence files, by name or because at least a quarter of their words
are a licence statement, set their directory's licence. A file without a licence of its own inherits that of its
nearest ancestor directory that has one: distinct directories are joined with their ancestors, then
files with their directory, so files aren't multiplied.

Inverse document frequencies are those of the templates, which are fixed; a word in no template counts as
the rarest.

Defined cases: null or empty text has no licence of its own; very long texts are scanned line by line, and are no licence's
full text; a stated SPDX expression goes before all else, as it is written; ties between templates go to the first by name, between licence files of a directory to the higher score, then the
smaller path; a null path has neither directory nor heir; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, saved, slices, table, texts

THRESHOLD = 0.5
WINDOW = 24
FILE_SHARE = 0.25
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
#: Short statements as headers and licence files use them.
TEMPLATES = {
    "0BSD": ("Licensed under the BSD Zero Clause License", "SPDX-License-Identifier: 0BSD"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-4-Clause": ("Licensed under the BSD 4-Clause License", "SPDX-License-Identifier: BSD-4-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under the Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under the Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under the Creative Commons Attribution NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": ("Made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License Version 2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "MIT-0": ("Licensed under the MIT No Attribution License", "SPDX-License-Identifier: MIT-0"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"),
}
#: Headers and grants as they stand in files, wrapped over lines; compared with whole paragraphs.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HEADERS = {
    "AGPL-3.0": (_GNU.format("Affero General Public License", 3),),
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',),
    "GPL-2.0": (_GNU.format("General Public License", 2),),
    "GPL-3.0": (_GNU.format("General Public License", 3),),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": (_GNU.format("Lesser General Public License", "2.1"),),
    "LGPL-3.0": (_GNU.format("Lesser General Public License", 3),),
    "MIT": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}
# Full texts of short licences, compared with whole files.
_AS_IS = "IS PROVIDED \"AS IS\""
_MIT_TEXT = HEADERS["MIT"][0] + f" The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_TEXT = HEADERS["ISC"][0] + f" THE SOFTWARE {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {"BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_END}",), "BSD-3-Clause": (f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_END}",), "ISC": (_ISC_TEXT,), "MIT": (_MIT_TEXT,)}
#: Cosine that a whole file needs to be a full text, and the words it may have; the texts have 120 to 230 themselves.
TEXT_THRESHOLD, TEXT_WORDS = 0.85, (80, 400)
#: Words of a paragraph that is compared with the headers; they have 30 to 70 themselves.
HEADER_WORDS = (15, 400)
_BLANK = re.compile(r"\n[\s#*/;%!\-]*\n")
_VERSION = re.compile(r"-(\d+)\.(\d+)$")
#: Words that tell licences of a family apart: a licence counts only if the words at hand have just the marks that its own have.
MARKS = {
    "affero": ("affero", "agpl"), "lesser": ("lesser", "lgpl"), "nc": ("nc", "noncommercial"), "nd": ("nd", "noderivatives", "noderivs"), "sa": ("sa", "sharealike"),
    "mit-0": ("mit 0", "no attribution"), "0-clause": ("0bsd", "zero clause", "0 clause"), "2-clause": ("2 clause",), "3-clause": ("3 clause",), "4-clause": ("4 clause",),
}
#: Families, by the beginning of a licence's name, and the marks that matter in them.
FAMILIES = {("AGPL", "GPL", "LGPL"): ("affero", "lesser"), ("CC-BY",): ("nc", "nd", "sa"), ("MIT",): ("mit-0",), ("BSD", "0BSD"): ("0-clause", "2-clause", "3-clause", "4-clause")}
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)")
_SPDX_PART = re.compile(r"\(|\)|[A-Za-z0-9.+\-]+")
_MENTION = re.compile(r"(?i)licen[cs]e|spdx|public domain|copyright")
_GRANT = re.compile(r"(?i)licen[cs]e|permission")
_AS_IS_SIGN = re.compile(r"(?i)as\s+is")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _marks(ws: list[str], names: tuple[str, ...]) -> frozenset[str]:
    """Which of the marks are among some words, as words or neighbouring words."""
    row = f" {' '.join(ws)} "
    return frozenset(n for n in names if any(f" {m} " in row for m in MARKS[n]))


def spdx(text: str) -> str | None:
    """The licence that the first SPDX line of a text states, an expression in upper-case operators; None without a valid one.

    What a name says of later versions (-only, -or-later, +) is left out. Names are those of the line, whether or not there is a template.
    """
    for found in _SPDX.finditer(text):
        parts, out, depth, name_next = _SPDX_PART.findall(found[1]), [], 0, True
        for part in parts:
            if part == "(" and name_next:
                depth += 1
            elif part == ")" and not name_next and depth:
                depth -= 1
            elif part.upper() in ("AND", "OR", "WITH") and not name_next:
                part, name_next = part.upper(), True
            elif name_next and part not in ("(", ")") and part.upper() not in ("AND", "OR", "WITH"):
                part, name_next = re.sub(r"(?:-only|-or-later|\+)$", "", part), False
            else:
                break  # what follows the expression
            out.append(part)
        while out and (out[-1] in ("AND", "OR", "WITH", "(")):  # words after it that look like operators
            out.pop()
        if out and out.count("(") == out.count(")"):
            return " ".join(out).replace("( ", "(").replace(" )", ")")
    return None


class Templates:
    """TF-IDF vectors of the templates, by word."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        lists = [(name, words(t)) for name in sorted(templates) for t in templates[name]]
        df = Counter(w for _, ws in lists for w in set(ws))
        n = len(lists)
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.rare = math.log(1 + n) + 1
        self.names = [name for name, _ in lists]
        versions = {name: _VERSION.search(name) for name in self.names if name != "CC0-1.0"}  # it has one version only
        self.versions = {name: re.compile(rf"[a-z]*{m[1]}(?:\.0)?" if m[2] == "0" else rf"[a-z]*{m[1]}\.{m[2]}") for name, m in versions.items() if m}
        self.marks = {name: (marks, _marks(words(name), marks)) for name in self.names for family, marks in FAMILIES.items() if name.startswith(family)}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, ws) in enumerate(lists):
            vector = {w: c * self.idf[w] for w, c in Counter(ws).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for w, v in vector.items():
                self.postings.setdefault(w, []).append((k, v / norm))

    def best(self, ws: list[str], marked: bool = False) -> tuple[float, str | None]:
        """(cosine, name) of the template nearest to some words, of those whose version is among the words; marked: and whose marks are those of the words."""
        vector = {w: c * self.idf.get(w, self.rare) for w, c in Counter(ws).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        dots: dict[int, float] = {}
        for w, v in vector.items():
            for k, t in self.postings.get(w, ()):
                dots[k] = dots.get(k, 0.0) + v * t
        agree = {n: any(map(v.fullmatch, vector)) for n in {self.names[k] for k in dots} if (v := self.versions.get(n))}
        dots = {k: d for k, d in dots.items() if agree.get(self.names[k], True)}
        has: dict[tuple, frozenset] = {}
        for name in {self.names[k] for k in dots} & self.marks.keys() if marked else ():
            marks, own_marks = self.marks[name]
            if marks not in has:
                has[marks] = _marks(ws, marks)
            clauses = "2-clause" in marks and not has[marks]  # a text of BSD conditions needn't count its clauses
            if has[marks] != own_marks and not clauses:
                dots = {k: d for k, d in dots.items() if self.names[k] != name}
        if not dots:
            return 0.0, None
        k = min(dots, key=lambda k: (-round(dots[k] / norm, 9), k))
        return round(dots[k] / norm, 9), self.names[k]


def segments(text: str) -> Iterator[list[str]]:
    """The words of each part of a text that mentions a licence."""
    lines = text.splitlines() if _MENTION.search(text) else []
    for n, line in enumerate(lines):
        if not _MENTION.search(line):
            continue
        ws = words(line)
        if len(ws) <= 2 * WINDOW:
            yield ws
            if n + 1 < len(lines) and len(more := words(lines[n + 1])) <= WINDOW // 2:
                yield ws + more
            for part in re.split(r"(?<=[.;!?])\s+", line):
                if len(part) < len(line) and _MENTION.search(part):
                    yield words(part)
            continue
        # Words with their places, so that each mention's window has whole words on both sides.
        places = [m.start() for m in _WORD.finditer(line.lower())] if line.isascii() else None
        for m in _MENTION.finditer(line):
            k = bisect.bisect_left(places, m.start()) if places is not None else len(words(line[: m.start()]))
            for before, behind in ((12, 12), (2, 6)):
                yield ws[max(0, k - before) : k + behind]


def paragraphs(text: str) -> Iterator[list[str]]:
    """The words of each paragraph (lines between blank ones, comment signs aside) that could hold a header."""
    if not _GRANT.search(text):
        return
    for part in _BLANK.split("\n".join(text.splitlines())):
        if _GRANT.search(part) and HEADER_WORDS[0] <= len(ws := words(part)) <= HEADER_WORDS[1]:
            yield ws


def own_license(text: str, templates: Templates, threshold: float = THRESHOLD, headers: Templates | None = None, whole: Templates | None = None) -> tuple[str | None, float, float]:
    """(licence, cosine, share of the text's words in its segment); (None, 0, 0) without one."""
    best, size = (0.0, None), 0
    if headers is not None and "SPDX-License-Identifier:" in text and (stated := spdx(text)):
        return stated, 1.0, len(words(stated)) / max(1, len(words(text)))
    if whole is not None and len(text) < 12 * TEXT_WORDS[1] and _AS_IS_SIGN.search(text):
        ws = words(text)
        if TEXT_WORDS[0] <= len(ws) <= TEXT_WORDS[1] and (found := whole.best(ws, marked=True))[0] >= TEXT_THRESHOLD:
            return found[1], found[0], 1.0
    parts = [(ws, templates) for ws in segments(text)]
    if headers is not None:
        parts += [(ws, headers) for ws in paragraphs(text)]
    for ws, known in parts:
        found = known.best(ws, marked=True)
        if found[0] >= threshold and (found[0] > best[0] or found[0] == best[0] and found[1] < best[1]):
            best, size = found, len(ws)
    if best[1] is None:
        return None, 0.0, 0.0
    return best[1], best[0], size / max(1, len(words(text)))


def directory(path: F.Column) -> F.Column:
    """The directory of a path, "" at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def own(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, path, own_license, own_score, share) of files (id, path, text)."""
    out = pa.schema([("id", pa.int64()), ("path", pa.string()), ("own_license", pa.string()), ("own_score", pa.float64()), ("share", pa.float64())])
    known = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, headers, whole = Templates(known), *((Templates(HEADERS), Templates(TEXTS)) if templates is None else (None, None))
        for b in slices(batches):
            found = [own_license(t, vectors, threshold, headers, whole) for t in texts(b.column(2))]
            yield batch(out, [b.column(0), b.column(1), *([f[k] for f in found] for k in range(3))])

    arrow_batches(files.sparkSession)
    return files.select("id", "path", "text").mapInArrow(run, "id long, path string, own_license string, own_score double, share double")


def resolve(scanned: DataFrame) -> DataFrame:
    """scanned with license (its own, else the inherited one), inherited_license and inherited_from (a directory); these null for an own licence or none."""
    placed = scanned.withColumn("dir", directory(F.col("path")))
    sets = placed.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(LICENSE_NAMES) | (F.col("share") >= FILE_SHARE)))
    sets = sets.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("best")).select(F.col("dir").alias("above"), F.col("best.own_license").alias("license"))
    dirs = placed.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts)))
    chains = dirs.select("dir", F.explode(depths).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    near = chains.join(sets, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("near"))
    joined = placed.join(near, "dir", "left")
    none = F.col("own_license").isNull()
    return joined.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "near.license").alias("license"), F.when(none, F.col("near.license")).alias("inherited_license"), F.when(none, F.col("near.above")).alias("inherited_from"))


def scan(files: DataFrame, **options) -> DataFrame:
    return resolve(saved(own(files, **options), "own-licenses"))


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: source/language/folder of 64 ids/id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("d"), F.expr("doc_id div 64")), F.concat(F.col("doc_id"), F.lit(".txt")))
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op9_license_scan(spark, sf_dir):
    return scan(document_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
