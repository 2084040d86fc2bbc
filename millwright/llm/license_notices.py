"""Licence notices beside the templates: names as they are cited, headings, and longer grants.

A citation (``under the MIT License``, ``CC BY-SA 3.0``, ``SPDX-License-Identifier: ISC``) is a phrase of normalised
words that must occur whole, wherever it stands; the longest at a place counts. A heading counts where it begins a
paragraph, and one without a version only where it is the whole line. A name without a version (``GPL``) is given only
where the document has no version of it.
"""

from __future__ import annotations

from functools import cache
from itertools import product

UNDER = ("under", "under the", "under a", "under an", "terms of the", "conditions of the", "accordance with the", "license")

_PARTS = {"BY": ["attribution"], "NC": ["noncommercial", "non commercial"], "SA": ["sharealike", "share alike"], "ND": ["noderivatives", "noderivs", "no derivatives", "no derivs", "no derivative works"]}
_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_GNU = {
    "GPL": (["gnu general public license", "gnu gpl", "gpl", "gnu general public license gpl", "gnu public license", "general public license"], ("1", "2", "3")),
    "LGPL": (["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "gnu lesser general public license lgpl", "gnu library or lesser general public license", "lesser general public license"], ("2", "2.1", "3")),
    "AGPL": (["gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "gnu affero general public license agpl", "gnu affero gpl"], ("1", "3")),
    "GFDL": (["gnu free documentation license", "gnu fdl", "gfdl", "gnu free documentation license gfdl"], ("1.1", "1.2", "1.3")),
}
_OTHER = {
    "Apache": (["apache license", "apache software license", "apache public license", "asl"], ("1.0", "1.1", "2.0")),
    "MPL": (["mozilla public license", "mpl", "mozilla public license mpl"], ("1.0", "1.1", "2.0")),
    "EPL": (["eclipse public license", "epl", "eclipse public license epl"], ("1.0", "2.0")),
    "EUPL": (["european union public license", "european union public licence", "eupl"], ("1.1", "1.2")),
    "CDDL": (["common development and distribution license", "cddl", "common development and distribution license cddl"], ("1.0", "1.1")),
    "CPL": (["common public license"], ("1.0",)),
    "Artistic": (["artistic license", "perl artistic license"], ("1.0", "2.0")),
    "BSL": (["boost software license"], ("1.0",)),
    "OFL": (["sil open font license", "open font license", "ofl"], ("1.0", "1.1")),
    "ODbL": (["open database license", "odc open database license", "odbl", "open database license odbl"], ("1.0",)),
    "AFL": (["academic free license"], ("2.1", "3.0")),
    "PostgreSQL": (["postgresql license"], ()),
}
# Names without versions: citations and headings.
_PLAIN = {
    "MIT": ["mit license", "mit x11 license", "mit x license", "x11 mit license", "mit expat license", "expat license", "mit license mit", "mit style license", "mit open source license", "mit software license"],
    "MIT-0": ["mit no attribution license", "mit no attribution", "mit 0 license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "bsd two clause license", "simplified bsd license", "freebsd license", "bsd 2 clause simplified license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "bsd three clause license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause new or revised license", "bsd 3 clause"],
    "BSD-4-Clause": ["bsd 4 clause license", "4 clause bsd license", "four clause bsd license", "original bsd license", "bsd 4 clause"],
    "BSD": ["bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license", "zlib libpng license", "zlib libpng"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "PSF-2.0": ["python software foundation license", "psf license", "python software foundation license version 2"],
    "CC0-1.0": ["cc0", "cc0 license", "creative commons zero", "creative commons cc0", "creative commons zero license"],
}
_SPDX = ["MIT", "MIT-0", "ISC", "Zlib", "Unlicense", "WTFPL", "PSF-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD"]

# Grants that are looked for in windows of their own length.
_GNU_GRANT = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_GNU_ONLY = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {v} as published by the Free Software Foundation."
GRANTS = {
    **{f"{f}-{v if '.' in v else v + '.0'}": [g.format(what=w, kind=k, v=v) for g, w in product((_GNU_GRANT, _GNU_ONLY), ("program", "library"))] for f, k, v in (("GPL", "", "1"), ("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Library ", "2"), ("LGPL", "Lesser ", "2"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))},
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "Unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def _versions(v: str) -> list[str]:
    """Ways to write a version, as normalised words: 3, 3 0, v3, v 3, version 3."""
    forms = {plain(v), *([plain(v) + " 0"] if "." not in v else [])}
    return [f"{p}{f}" for p, f in product(("", "v", "v ", "version "), sorted(forms))]


@cache
def phrases() -> tuple[dict[tuple[str, ...], str], dict[tuple[str, ...], str], dict[tuple[str, ...], str]]:
    """Words to name: citations anywhere, headings that begin a paragraph, headings that are a whole line."""
    cited, begins, whole = {}, {}, {}
    put = lambda table, text, name: table.setdefault(tuple(text.split()), name)
    for family, (titles, versions) in {**_GNU, **_OTHER}.items():
        for title in titles:
            for u in UNDER:
                put(cited, f"{u} {title}", family)
            for v in versions:
                name = f"{family}-{v if '.' in v else v + '.0'}"
                short = family.lower() if family in _GNU else None
                for form in [f"{title} {f}" for f in _versions(v)] + [f"{title} {f} license" for f in _versions(v)] + ([f"{short}v{plain(v)}", f"{short}{plain(v)}"] if short else []) + ([f"apache {plain(v)} license", f"apache {plain(v)}", f"apache v{plain(v)}"] if family == "Apache" else []):
                    for u in UNDER:
                        put(cited, f"{u} {form}", name)
                    put(begins, form, name)
                    put(begins, f"the {form}", name)
                    put(cited, f"{form} or later", name)
                for f, u in product([f"version {plain(v)} of the {title}", f"v{plain(v)} of the {title}"], ("under", "of", "to", "terms of")):
                    put(cited, f"{u} {f}", name)
                put(cited, f"spdx license identifier {plain(family)} {plain(v)}", name)
    for name, titles in _PLAIN.items():
        for title in titles:
            for u in UNDER:
                put(cited, f"{u} {title}", name)
            for line in (title, f"the {title}", f"{title} {plain(name)}", f"the {title} {plain(name)}"):
                put(whole, line, name)
    for name in _SPDX:
        put(cited, f"spdx license identifier {plain(name)}", name)
        for form in (f"license {plain(name)}", f"licensed under {plain(name)}"):
            put(whole, form, name)
    put(cited, "mit licensed", "MIT")
    put(cited, "licensed under mit", "MIT")
    put(cited, "cc0 1 0", "CC0-1.0")
    put(cited, "creative commons zero v1 0", "CC0-1.0")
    for form in ("released into the public domain", "placed in the public domain", "dedicated to the public domain", "in the public domain worldwide"):
        put(cited, form, "Public-Domain")
    put(cited, "all rights reserved", "Proprietary")
    for kind in _CC:
        parts = kind.split("-")
        words = [" ".join(x) for x in product(*[_PARTS[p] for p in parts])]
        short = plain(kind)
        titles = [f"cc {short}", f"creative commons {short}", *[f"creative commons {w}" for w in words], *[f"cc {w}" for w in words]]
        for title in titles:
            for v in _CC_VERSIONS:
                for f in (plain(v), f"v{plain(v)}", f"version {plain(v)}", f"license {plain(v)}", f"license version {plain(v)}"):
                    put(cited, f"{title} {f}", f"CC-{kind}-{v}")
            for u in ("under", "under a", "under the"):
                put(cited, f"{u} {title}", f"CC-{kind}")
            put(cited, f"{title} license", f"CC-{kind}")
        for v in _CC_VERSIONS:
            put(cited, f"creativecommons org licenses {short} {plain(v)}", f"CC-{kind}-{v}")
            for w in words:  # the heading of the licence's own text
                put(begins, f"{w} {plain(v)} international", f"CC-{kind}-{v}")
    put(cited, "creativecommons org publicdomain zero 1 0", "CC0-1.0")
    return cited, begins, whole


def trie(table: dict[tuple[str, ...], str]) -> dict:
    """Nested dictionaries by word; a name stands at key None."""
    root: dict = {}
    for words, name in table.items():
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node[None] = name
    return root


def longest(root: dict, words: list[str], i: int) -> tuple[str, int] | None:
    """Name and end of the longest phrase that begins at word i."""
    node, best = root, None
    for k in range(i, len(words)):
        node = node.get(words[k])
        if node is None:
            break
        if None in node:
            best = node[None], k + 1
    if best is None:
        return None
    # A number that goes on is another version.
    nxt = words[best[1]] if best[1] < len(words) else ""
    if words[best[1] - 1].lstrip("abcdefghijklmnopqrstuvwxyz").isdigit() and nxt.isdigit() and len(nxt) == 1 and nxt != "0":
        return None
    return best


def cited_names(words: list[str], line: list[int], heads: set[int]) -> list[tuple[str, int]]:
    """Name and first word of the citations and headings in a document's words.

    ``line`` is the line of each word; ``heads`` are the lines that begin a paragraph.
    """
    cited, begins, whole = _tries()
    out, stop = [], 0
    for i, w in enumerate(words):
        fresh = not i or line[i - 1] != line[i]
        hits = []
        if w in cited:
            hits.append(longest(cited, words, i))
        if fresh and w in begins and line[i] in heads:
            hits.append(longest(begins, words, i))
        if fresh and w in whole:
            end = i
            while end < len(words) and line[end] == line[i]:
                end += 1
            hit = longest(whole, words[i:end], 0)
            hits.append((hit[0], end) if hit and i + hit[1] == end else None)
        hits = [h for h in hits if h]
        if hits:
            name, end = max(hits, key=lambda h: h[1])
            if end > stop:
                out.append((name, i))
                stop = end
    return out


@cache
def _tries():
    return tuple(trie(t) for t in phrases())


def unversioned() -> list[str]:
    """Names that give way to a version of them."""
    return [*_GNU, *_OTHER, "BSD", *[f"CC-{k}" for k in _CC]]


def versions_only(names: set[str]) -> set[str]:
    """Without the names of which a version is there too; a dedication to the public domain by name counts by that name."""
    if names & {"Unlicense", "CC0-1.0"}:
        names = names - {"Public-Domain"}
    gives = {n for n in names if n in _UNVERSIONED and any(m.startswith(f"{n}-") and (m[len(n) + 1].isdigit()) for m in names)}
    return names - gives


_UNVERSIONED = frozenset(unversioned())


# Whole texts of short licences as published by their authors, without the lines that name a holder (fixed values).
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
FULL_TEXTS = {
    "MIT": [f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "BSD-2-Clause": [f"{_BSD_2} {_BSD}"],
    "BSD-3-Clause": [f"{_BSD_2} {_BSD_3} {_BSD}"],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""],
    "Unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""],
    "BSL-1.0": ["""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""],
}
