"""License scans (operator 4): patience alignment of texts with templates.

A template is found where a stretch of a text covers at least ``COVERAGE`` of
its words in order. Words that are unique to both the stretch and the template
are the anchors; the longest increasing subsequence of their places keeps the
consistent ones, and the gaps between them are aligned the same way, after
equal words at the gap's ends have been taken. Words are compared in lower
case, without punctuation.

Stretches: at most ``miss`` = floor((1 - COVERAGE) * words) words of a template
may be absent, so of any ``miss`` + 1 template places one is matched. The
places whose words are rarest in the text give the candidate stretches. A text
in which more than ``miss`` words do not occur at all is passed over.

Licenses that share most of their words are told apart by what a template has
in ``[[ ]]``: its version and variant, which the stretch must hold word for
word. Of templates found in overlapping stretches only the one with the most
matched words is kept, so a BSD-3 text is not a BSD-2 text as well. A license
may have several wordings, each a template of its own.

A tag ``SPDX-License-Identifier`` is a template per identifier; the further
identifiers of its expression (after ``OR``, ``AND`` or ``WITH`` an exception)
are read on from its end.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R

COVERAGE = 0.9
_WORD = re.compile(r"[^\W_]+")
_MUST = re.compile(r"\[\[(.*?)\]\]", re.S)
_TAG = ["spdx", "license", "identifier"]

# Wordings of public license notices; [[ ]] holds what tells a license from its relatives.
TEMPLATES = {
    "MIT": "Released under the [[MIT]] License.",
    "Apache-2.0": "Licensed under the [[Apache]] License, [[Version 2.0]].",
    "GPL-3.0": "This work is licensed under the [[GNU General]] Public License, [[version 3]].",
    "CC-BY-NC-4.0": "Licensed under [[CC BY-NC 4.0]].",
    "CC-BY-4.0": "This work is licensed under a Creative Commons [[Attribution 4.0]] International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons [[Attribution-ShareAlike 4.0]] International License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "Apache-2.0-header": (
        "Licensed under the [[Apache]] License, [[Version 2.0]] (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the [[GNU General "
        "Public License]] as published by the Free Software Foundation, either [[version 3 of]] the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, [[provided that the above copyright notice]] and this permission notice appear in all copies."),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
}

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_AUTHOR_DISCLAIMS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
_HOLDERS_DISCLAIM = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_NO_ENDORSEMENT = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to [[endorse or promote "
    "products]] derived from this software without specific prior written permission.")
_ADVERTISING = (
    " All [[advertising materials mentioning features]] or use of this software must display the following "
    "acknowledgement: This product includes software developed by the copyright holder.")


# Names by which notices call a license; a version is added by rule.
_UNVERSIONED = {
    "MIT": ("MIT License", "Expat License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "0BSD": ("Zero-Clause BSD License", "0-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License",
                     "Revised BSD License"),
}
_VERSIONED = {
    "Apache": (("2.0",), ("Apache License", "Apache Software License", "Apache")),
    "MPL": (("1.1", "2.0"), ("Mozilla Public License", "MPL")),
    "EPL": (("1.0", "2.0"), ("Eclipse Public License", "EPL")),
    "BSL": (("1.0",), ("Boost Software License",)),
    "GPL": (("2.0", "3.0"), ("GNU General Public License", "GNU GPL", "GPL")),
    "LGPL": (("2.0", "2.1", "3.0"), ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL")),
    "AGPL": (("3.0",), ("GNU Affero General Public License", "GNU AGPL", "AGPL")),
}
# Identifiers of the public license list that tags are searched for.
_SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 "
    "BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CPL-1.0 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 "
    "GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL NCSA ODbL-1.0 "
    "OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1").split()
# Titles that open the legal texts.
_TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "GPL-2.0": "GNU General Public License Version 2, June 1991",
    "GPL-3.0": "GNU General Public License Version 3, 29 June 2007",
    "LGPL-2.0": "GNU Library General Public License Version 2, June 1991",
    "LGPL-2.1": "GNU Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions",
    "EPL-2.0": "Eclipse Public License - v 2.0 The accompanying program is provided under the terms",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}


def _named() -> dict[str, tuple[str, ...]]:
    """Wordings that call a license by its name: "under the ...", "under the
    terms of the ..." and "licensed under ..."."""
    names = {k: list(v) for k, v in _UNVERSIONED.items()}
    for code, (versions, full) in _VERSIONED.items():
        for v in versions:
            numbers = (v, v.removesuffix(".0")) if v.endswith(".0") else (v,)
            names[f"{code}-{v}"] = [f"{name}{glue}{n}" for name in full for n in numbers
                                    for glue in (" ", " version ", " v", " v. ", "v")]
    return {f"{k}-named": tuple(x for n in forms for x in (f"under the [[{n}]]", f"under the terms of the [[{n}]]",
                                                            f"licensed under [[{n}]]"))
            for k, forms in names.items()}


def _notices() -> dict[str, str]:
    """Notices that differ in a name and a version alone."""
    out = {}
    for code, name, versions in (("GPL", "General", ("2.0", "3.0")), ("AGPL", "Affero General", ("3.0",)),
                                 ("LGPL", "Lesser General", ("2.1", "3.0")), ("LGPL", "Library General", ("2.0",))):
        for v in versions:
            number = v.removesuffix(".0")
            gnu = f"[[GNU {name} Public License]]"
            out[f"{code}-{v}"] = f"This work is licensed under the [[GNU {name}]] Public License, [[version {number}]]."
            for kind, terms in (("header", f"{gnu} as published by the Free Software Foundation, either [[version {number} of]] the "
                                           "License, or (at your option) any later version."),
                                ("only-header", f"[[GNU {name} Public License version {number} as]] published by the Free Software "
                                                "Foundation.")):
                out[f"{code}-{v}-{kind}"] = (
                    f"This program is free software: you can redistribute it and/or modify it under the terms of the {terms} This "
                    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                    f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more "
                    "details.")
    for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                       ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v, scope in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            out[f"CC-{code}-{v}-notice"] = f"This work is licensed under a Creative Commons [[{name} {v}]] {scope} License."
            out[f"CC-{code}-{v}-tag"] = f"Licensed under [[CC {code} {v}]]."
    return out


def _all_templates(templates: dict[str, str]) -> dict[str, str | tuple[str, ...]]:
    """With whole texts and further notices; a wording has one name."""
    bsd = templates["BSD-2-Clause-text"]
    out = templates | {
        "MIT-whole-text": f"{templates['MIT-text']} {_AS_IS}",
        "ISC-whole-text": f"{templates['ISC-text']} {_AUTHOR_DISCLAIMS}",
        "0BSD-whole-text": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                            f"fee [[is hereby granted THE SOFTWARE]]{_AUTHOR_DISCLAIMS.removeprefix('THE SOFTWARE')}"),
        "BSD-2-Clause-whole-text": f"{bsd} {_HOLDERS_DISCLAIM}",
        "BSD-3-Clause-text": bsd + _NO_ENDORSEMENT,
        "BSD-3-Clause-whole-text": f"{bsd}{_NO_ENDORSEMENT} {_HOLDERS_DISCLAIM}",
        "BSD-4-Clause-text": bsd + _ADVERTISING + _NO_ENDORSEMENT,
        "BSD-4-Clause-whole-text": f"{bsd}{_ADVERTISING}{_NO_ENDORSEMENT} {_HOLDERS_DISCLAIM}",
        "BSD-3-Clause": "Released under the [[BSD 3-Clause]] License.",
        "BSD-2-Clause": "Released under the [[BSD 2-Clause]] License.",
        "MPL-2.0": "Licensed under the [[Mozilla]] Public License, [[Version 2.0]].",
        "MPL-2.0-header": (
            "This Source Code Form is subject to the terms of the [[Mozilla Public License, v. 2.0]]. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        "All-rights-reserved": "[[All rights reserved]].",
        "CC0-1.0": "This work is licensed under [[CC0 1.0]] Universal.",
        "CC0-1.0-tag": "Licensed under [[CC0 1.0]].",
        "CC0-1.0-waiver": (
            "To the extent possible under law, the author has [[waived all copyright]] and related or neighboring rights to "
            "this work."),
        "CC0-1.0-dedication": (
            "To the extent possible under law, the author(s) have [[dedicated all copyright]] and related and neighboring "
            "rights to this software to the public domain worldwide. This software is distributed without any warranty. You "
            "should have received a copy of the CC0 Public Domain Dedication along with this software."),
        "Unlicense-text": (
            "This is free and [[unencumbered software]] released into the public domain. Anyone is free to copy, modify, publish, "
            "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
            "purpose, commercial or non-commercial, and by any means."),
        "Zlib-text": (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
            "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
            "for any purpose, including commercial applications, and to [[alter it and redistribute it freely]], subject to the "
            "following restrictions:"),
        "BSL-1.0-notice": (
            "Distributed under the [[Boost Software License, Version 1.0]]. (See accompanying file LICENSE_1_0.txt or copy at "
            "https://www.boost.org/LICENSE_1_0.txt)"),
    }
    out |= {f"{k}-title": f"[[{v}]]" for k, v in _TITLES.items()}
    known = {tuple(words(v)) for v in out.values()}
    out |= {k: v for k, v in _notices().items() if k not in out and tuple(words(v)) not in known}
    return out | _named() | {f"{i}-spdx": f"SPDX-License-Identifier: [[{i}]]" for i in _SPDX}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


TEMPLATES = _all_templates(TEMPLATES)


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    ends, at, back = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen: dict[str, list[int]] = {}
        for side, (w, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                e = seen.setdefault(w[i], [0, 0, 0, 0])
                e[2 * side] += 1
                e[2 * side + 1] = i
        anchors = sorted((e[1], e[3]) for e in seen.values() if e[0] == 1 and e[2] == 1)
        kept = [anchors[i] for i in _increasing([j for _, j in anchors])]
        if not kept:
            continue
        out.extend(kept)
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo.extend((i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(ends, ends[1:]))
    return sorted(out)


class Scanner:
    """All templates, with their words; a template may be several wordings."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(k, w, [m for x in _MUST.findall(v) if (m := words(x))])
                          for k, forms in sorted(templates.items())
                          for v in ((forms,) if isinstance(forms, str) else forms) if (w := words(v))]
        self.vocabulary = {x for _, w, _ in self.templates for x in w}
        # a template whose longest distinguishing word is not in a text cannot be found there
        self.always, self.by_word = [], {}
        for k, (_, _, must) in enumerate(self.templates):
            if must:
                self.by_word.setdefault(max((w for m in must for w in m), key=len), []).append(k)
            else:
                self.always.append(k)
        self.tags = {tuple(w[len(_TAG):]): name for name, w, _ in self.templates if w[:len(_TAG)] == _TAG}
        self.tag_names = set(self.tags.values())

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) for each template found
        where no better one overlaps; the best stretch, the first of equals."""
        x = words(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(x):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        hits = []
        for k in self.always + [k for w in places for k in self.by_word.get(w, ())]:
            _, t, must = self.templates[k]
            if not all(w in places for m in must for w in m):
                continue
            miss = int((1 - self.coverage) * len(t) + 1e-9)
            if sum(w not in places for w in t) > miss:
                continue
            rare = sorted(range(len(t)), key=lambda i: len(places.get(t[i], ())))[:miss + 1]
            starts = sorted({p - i for i in rare for p in places.get(t[i], ())})
            for lo, hi in self._stretches(starts, len(t), miss, len(x)):
                pairs = patience(t, x[lo:hi])
                found = self._densest(pairs, len(t) + miss)
                if found and found[0] >= self.coverage * len(t):
                    first, last = lo + found[1], lo + found[2]
                    if all(self._holds(x, first, last, m) for m in must):
                        hits.append((-found[0], len(t), first, last, k))
        out = {}
        taken: list[tuple[int, int]] = []  # ascending, apart from each other
        for count, n, first, last, k in sorted(set(hits)):
            at = bisect_left(taken, (first, first))
            if at < len(taken) and taken[at][0] <= last or at and taken[at - 1][1] >= first:
                continue
            taken.insert(at, (first, last))
            name = self.templates[k][0]
            out.setdefault(name, (name, -count / n, first, last))
            if name in self.tag_names:
                for more, lo, hi in self._expression(x, last + 1):
                    out.setdefault(more, (more, 1.0, lo, hi))
        return [out[k] for k in sorted(out)]

    def _expression(self, x: list[str], at: int):
        """(template, first word, last word) of the identifiers that a tag's
        expression goes on with at a place of the text."""
        longest = max(map(len, self.tags))
        while at < len(x):
            if x[at] == "with" and "exception" in x[at:at + 6]:
                at = x.index("exception", at) + 1
                while at < len(x) and x[at].isdigit():
                    at += 1
            if at >= len(x) or x[at] not in ("or", "and"):
                return
            n = next((n for n in range(longest, 0, -1) if tuple(x[at + 1:at + 1 + n]) in self.tags), 0)
            if not n:
                return
            yield self.tags[tuple(x[at + 1:at + 1 + n])], at + 1, at + n
            at += n + 1

    @staticmethod
    def _holds(x: list[str], first: int, last: int, phrase: list[str]) -> bool:
        n = len(phrase)
        return any(x[i:i + n] == phrase for i in range(first, last + 2 - n))

    @staticmethod
    def _stretches(starts: list[int], n: int, miss: int, size: int):
        """Word ranges for supposed template starts: of the template's length,
        in which few words occur twice, and wider ones for insertions; wide
        ranges that overlap by nearly all of their length are one."""
        last = None
        for s in starts:
            yield max(0, s), min(size, s + n)
            if last is None or s - last > miss:
                last = s
                yield max(0, s - miss), min(size, s + n + 2 * miss)

    @staticmethod
    def _densest(pairs: list[tuple[int, int]], width: int):
        """Most matched words within ``width`` words of text: (count, first, last)."""
        best, i = None, 0
        for j in range(len(pairs)):
            while pairs[j][1] - pairs[i][1] >= width:
                i += 1
            if best is None or j - i + 1 > best[0]:
                best = (j - i + 1, pairs[i][1], pairs[j][1])
        return best


def _scan_udf(templates: dict[str, str | tuple[str, ...]], coverage: float):
    made: list[Scanner] = []

    @F.pandas_udf("array<struct<license:string,coverage:double,first_word:int,last_word:int>>")
    def scan(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Scanner(templates, coverage))
        return pd.Series([[dict(zip(("license", "coverage", "first_word", "last_word"), r)) for r in made[0].scan(t)]
                          for t in texts], dtype=object)
    return scan


def scan_licenses(df: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, coverage: float = COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and template found in it: ``id_col``, ``license``,
    ``coverage``, ``first_word``, ``last_word``.

    Defined cases: NULL, empty and word-less texts hold no license; templates
    without words are left out; of templates that overlap in one place the one
    with the most matched words is reported; a template that occurs more than
    once is reported at its best covered place, the first of equals; repeated
    rows are reported each. A tag with an unknown first identifier is no find;
    an expression is read up to its first unknown identifier, ``+`` is ignored.
    """
    found = _scan_udf(TEMPLATES if templates is None else templates, coverage)(R.quoted(text_col))
    out = df.select(R.quoted(id_col).alias("id"), F.explode(found).alias("f"))
    return out.select(F.col("id").alias(id_col), "f.license", "f.coverage", "f.first_word", "f.last_word")
