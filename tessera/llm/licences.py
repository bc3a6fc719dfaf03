"""Licence notices by the Dice coefficient over word bigrams, in DataFrame operations only.

A document is normalised (A-Z lower-cased, everything but a-z and 0-9 a gap) and each window of its words,
whatever its lines, is compared to the licence templates: twice the number of shared distinct word bigrams
over the sum of both numbers. Templates are short notices, usual file headers and whole texts of licences.

Size bounds prune the templates and the windows. A coefficient of at least t needs numbers of bigrams within
a factor of (2 - t) / t, so no window is longer than that, and at least t / (2 - t) of the template's bigrams
in the window. So a document without certain words (probes(): those of more than 1 - t / (2 - t) of the
bigrams) meets no template; one without as many of a template's bigrams does not meet that template; and only
windows that begin with a bigram of the template are gone through.

Defined results: a null or empty text, and one of fewer than two words, has no bigrams and matches nothing;
of windows with the same coefficient the first, then the shortest wins, of templates the longest window, then
the first by name; repeated rows each get their own result; columns whose names clash with the new ones, in
whatever case, give way; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices and opening paragraphs of well-known licences (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "all-rights-reserved": "All rights reserved.",
}
#: Whole texts of short licences and the usual file headers of long ones (fixed values).
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_CC = "This work is licensed under a Creative Commons {} International License."
TEXTS = {
    "AGPL-3.0-notice": _GPL.format("Affero General Public License", 3),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": f"{_BSD_CLAUSES} {_BSD_WARRANTY}",
    "BSD-3-Clause-text": f"{_BSD_CLAUSES} {_BSD_NAMES} {_BSD_WARRANTY}",
    "BSD-clauses": _BSD_CLAUSES,
    "BSL-1.0-text": f"{_BOOST} {_MIT_WARRANTY}",
    "CC-BY-NC-SA-4.0": _CC.format("Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-ND-4.0": _CC.format("Attribution-NoDerivatives 4.0"),
    "CC-BY-SA-4.0": _CC.format("Attribution-ShareAlike 4.0"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0-notice": _GPL.format("General Public License", 2),
    "GPL-3.0-notice": _GPL.format("General Public License", 3),
    "GPL-warranty": _GPL_WARRANTY,
    "ISC-text": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "LGPL-2.1-notice": _GPL.format("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _GPL.format("Lesser General Public License", 3),
    "MIT-text": f"{_MIT_GRANT} {_MIT_WARRANTY}",
    "MIT-title": "MIT License",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": f"{_UNLICENSE} {_MIT_WARRANTY}",
    "Zlib-text": _ZLIB,
}
PERCENT = 80


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def probes(templates: dict[str, list[str]], percent: int = PERCENT) -> list[str]:
    """Words one of which any document has that matches a template: without them each template has too few
    bigrams left to match. The word that takes most of what is still to be taken from all templates goes
    first, long words before short ones, as those are rare elsewhere."""
    # bigrams still standing, and how many more must go
    left = {k: (v, len(v) - -(-len(v) * percent // (200 - percent)) + 1) for k, v in templates.items()}
    out: list[str] = []
    while left:
        gain: dict[str, int] = {}
        for own, need in left.values():
            held: dict[str, int] = {}
            for g in own:
                for w in set(g.split()):
                    held[w] = held.get(w, 0) + 1
            for w, n in held.items():
                gain[w] = gain.get(w, 0) + min(n, need)
        best = max(sorted(gain), key=lambda w: gain[w] * max(len(w) - 3, 0.01) ** 2)
        out.append(best)
        after = {k: [g for g in own if best not in g.split()] for k, (own, _) in left.items()}
        left = {k: (after[k], need - len(own) + len(after[k])) for k, (own, need) in left.items()}
        left = {k: v for k, v in left.items() if v[1] > 0}
    return sorted(out)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bigrams(text: Column) -> Column:
    """array<struct<x, pos, before>>: the bigrams in their order, and where each stood last before (else 0)."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    plain = _let(
        words,
        lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)),
    )
    placed = F.array_sort(F.transform(plain, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("pos"))))

    def with_before(s: Column) -> Column:
        found = F.transform(s, lambda v, i: F.struct(v["pos"].alias("pos"), v["x"].alias("x"), F.when((i > 0) & (F.get(s, i - 1)["x"] == v["x"]), F.get(s, i - 1)["pos"]).otherwise(0).alias("before")))
        return F.array_sort(found)

    return _let(placed, with_before)


def _best_window(marks: Column, k: Column, most: Column, percent: int) -> Column:
    """struct<d (dice in per mille, negative), word, words> of the best window of a template of k bigrams, or
    null; marks are the document's bigrams as struct<pos, before, own>."""

    def of(start: Column) -> Column:
        i = start["pos"]

        def step(acc: Column, m: Column) -> Column:
            fresh = m["before"] < i
            n = acc["n"] + fresh.cast("int")
            s = acc["s"] + (fresh & m["own"]).cast("int")
            d = F.when(s * 200 >= (n + k) * percent, F.floor(s * 2000 / (n + k)).cast("int")).otherwise(0)
            return F.struct(n.alias("n"), s.alias("s"), F.greatest(acc["d"], d).alias("d"), F.when(d > acc["d"], m["pos"] - i + 1).otherwise(acc["e"]).alias("e"))

        best = F.aggregate(F.slice(marks, i, most), F.struct(*[F.lit(0).alias(c) for c in "nsde"]), step)
        return _let(best, lambda b: F.when(b["d"] > 0, F.struct((-b["d"]).alias("d"), i.alias("word"), (b["e"] + 1).alias("words"))))

    return F.array_min(F.transform(F.filter(marks, lambda m: m["own"]), of))


_FOUND = "array<struct<licence:string,word:int,words:int,dice:int>>"


def notices(docs: DataFrame, text_col: str = "text", percent: int = PERCENT, templates: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), notices (array<struct<licence, word, words, dice>>: of each template
    that a window of words matches the best window, the first and shortest of equals; words count from 1, dice
    in per mille, rounded down) and notice (the best, else null)."""
    own = {k: bigrams_of(v) for k, v in sorted((templates or TEMPLATES | TEXTS).items())}
    own = {k: v for k, v in own.items() if v}
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("g"), F.lit(len(v)).alias("k"), F.lit(len(v) * (200 - percent) // percent).alias("most")) for k, v in own.items()])
    every = F.array(*map(F.lit, sorted({g for v in own.values() for g in v})))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("notices", "notice")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    may = text.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(probes(own, percent))})(?![a-z0-9])")

    def search(g: Column) -> Column:
        shared = F.array_intersect(every, F.transform(g, lambda b: b["x"]))
        fits = _let(shared, lambda c: F.filter(known, lambda t: F.size(F.array_intersect(t["g"], c)) * (200 - percent) >= t["k"] * percent))

        def of(t: Column) -> Column:
            marks = F.transform(g, lambda b: F.struct(b["pos"].alias("pos"), b["before"].alias("before"), F.array_contains(t["g"], b["x"]).alias("own")))
            best = _let(marks, lambda m: _best_window(m, t["k"], t["most"], percent))
            return _let(best, lambda b: F.when(b.isNotNull(), F.struct(t["name"].alias("licence"), b["word"].alias("word"), b["words"].alias("words"), (-b["d"]).alias("dice"))))

        return F.filter(F.transform(fits, of), lambda x: x.isNotNull())

    found = F.when(may, _let(_bigrams(text), search)).otherwise(F.array().cast(_FOUND))
    df = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)], found.alias("notices"))
    best = F.array_min(F.transform("notices", lambda h: F.struct((-h["dice"]).alias("d"), (-h["words"]).alias("w"), h["licence"].alias("licence"))))["licence"]
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "notices", best.alias("notice"))
