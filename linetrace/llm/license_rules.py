"""Known licences as data: names, sentences, SPDX identifiers, and the rules over them.

Names and sentences are normalised: lower case, words of letters and digits, one space between."""

from __future__ import annotations

import re

# Licences by SPDX identifier, and the names under which notices speak of them.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("0BSD", ("zero clause bsd license", "bsd zero clause license", "0bsd license")),
    ("AFL-3.0", ("academic free license version 3 0", "academic free license 3 0")),
    ("AGPL-3.0", ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "gnu agpl v3", "agpl v3", "agplv3", "agpl 3 0")),
    ("Apache-1.1", ("apache software license version 1 1", "apache license version 1 1")),
    ("Apache-2.0", ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0", "apache 2 0", "apache 2 license", "apache license v2 0", "apache license version 2")),
    ("Artistic-2.0", ("artistic license 2 0", "artistic license version 2 0")),
    ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause")),
    ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause")),
    ("BSL-1.0", ("boost software license version 1 0", "boost software license 1 0", "boost software license")),
    ("CC-BY-3.0", ("cc by 3 0", "creative commons attribution 3 0 unported license", "creative commons attribution 3 0 license")),
    ("CC-BY-4.0", ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license")),
    ("CC-BY-NC-4.0", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
    ("CC-BY-NC-ND-4.0", ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license")),
    ("CC-BY-NC-SA-4.0", ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license")),
    ("CC-BY-ND-4.0", ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license")),
    ("CC-BY-SA-3.0", ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0 license")),
    ("CC-BY-SA-4.0", ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license")),
    ("CC0-1.0", ("cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 1 0", "cc0")),
    ("CDDL-1.0", ("common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0", "cddl")),
    ("EPL-1.0", ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0")),
    ("EPL-2.0", ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0")),
    ("EUPL-1.2", ("european union public licence version 1 2", "european union public license version 1 2", "eupl version 1 2", "eupl 1 2")),
    ("GPL-2.0", ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gplv2", "gpl v2", "gpl 2 0")),
    ("GPL-3.0", ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gplv3", "gpl v3", "gpl 3 0")),
    ("ISC", ("isc license", "isc licence")),
    ("LGPL-2.1", ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1")),
    ("LGPL-3.0", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0")),
    ("MIT", ("mit license", "mit licence", "expat license", "mit x11 license", "mit expat license")),
    ("MPL-1.1", ("mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1")),
    ("MPL-2.0", ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0")),
    ("MS-PL", ("microsoft public license",)),
    ("ODbL-1.0", ("open database license", "open data commons open database license")),
    ("OFL-1.1", ("sil open font license version 1 1", "sil open font license 1 1")),
    ("PostgreSQL", ("postgresql license",)),
    ("Python-2.0", ("python software foundation license version 2", "python software foundation license")),
    ("Unlicense", ("unlicense", "unlicense license")),
    ("WTFPL", ("do what the fuck you want to public license", "wtfpl")),
    ("Zlib", ("zlib license", "zlib libpng license")),
)
#: The name that stands for a bare "MIT" (followed by punctuation, "or", "and", "licensed" or an end).
BARE = "mit expat license"
#: What denies a notice, what leads to a name in one, and what joins further names to it; all may stand
#: anywhere in a sentence.
DENIED = "(?:not|never|no longer|nor|t|formerly|previously)"
_VERB = (
    "(?:licensed|relicensed|sublicensed|released|distributed|redistributed|available|provided|published|covered|governed|issued|shared|offered|made|placed|put|used|usable|reusable"
    "|is|are|was|comes|come|falls|fall|it|them|code|software|library|project|program|work|package)"
)
_OF = "(?: either(?: of)?| both)?(?: the| an| a)?(?: terms(?: and conditions)? of(?: the| an| a)?| conditions of(?: the| an| a)?)?"
LEAD = f"(?:{DENIED} (?:been |be |being |yet |currently )?(?:{_VERB} )?under|{_VERB} under|(?:{DENIED} )?(?:governed|covered|bound) by|(?:{DENIED} )?subject to|license is(?: not)?){_OF}"
NO = f"^(?:{DENIED} .*|non .*|license is not .*)$"
_JOIN = "(?: and or| or| and| as well as)(?: alternatively)?(?: under)?(?: the| an| a)?(?: terms of the)?"
_LATER = "(?: licenses?)?(?: or (?:any )?(?:later|newer)(?: versions?)?)?"

_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation "
_HOPE = "is distributed in the hope that it will be useful but without any warranty"
#: Sentences of licence texts and file headers; they too may stand anywhere in a sentence.
SENTENCES: dict[str, str] = {
    "mit license": "mit_title",
    "mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    _FREE.format("") + "either version 2 of the license or at your option any later version": "gpl2_grant",
    _FREE.format("") + "version 2": "gpl2_grant",
    _FREE.format("") + "either version 3 of the license or at your option any later version": "gpl3_grant",
    _FREE.format("") + "version 3": "gpl3_grant",
    _FREE.format("affero ") + "either version 3 of the license or at your option any later version": "agpl3_grant",
    _FREE.format("affero ") + "version 3": "agpl3_grant",
    _FREE.format("lesser ") + "either version 2 1 of the license or at your option any later version": "lgpl21_grant",
    _FREE.format("lesser ") + "version 2 1": "lgpl21_grant",
    _FREE.format("lesser ") + "either version 3 of the license or at your option any later version": "lgpl3_grant",
    _FREE.format("lesser ") + "version 3": "lgpl3_grant",
    _HOPE: "gpl_hope",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_subject",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "anyone is free to copy modify publish use compile sell or distribute this software": "unlicense_free",
    "has waived all copyright and related or neighboring rights": "cc0_waiver",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost_grant",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib_marked",
    "you just do what the fuck you want to": "wtfpl_grant",
    "all rights reserved": "reserved",
}
#: Licence, and the identifiers that must occur in this order, others in between allowed.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_grant", "mit_keep")),
    ("MIT", ("mit_title", "mit_grant")),
    ("Apache-2.0", ("apache2_comply", "apache2_as_is")),
    ("GPL-2.0", ("gpl2_grant",)),
    ("GPL-3.0", ("gpl3_grant",)),
    ("AGPL-3.0", ("agpl3_grant",)),
    ("LGPL-2.1", ("lgpl21_grant",)),
    ("LGPL-3.0", ("lgpl3_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("zero_grant",)),
    ("MPL-2.0", ("mpl2_subject",)),
    ("Unlicense", ("unlicense_grant", "unlicense_free")),
    ("CC0-1.0", ("cc0_waiver",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Zlib", ("zlib_as_is", "zlib_marked")),
    ("WTFPL", ("wtfpl_grant",)),
)
#: A text that meets the second licence's rule is not reported under the first one's.
OUTDONE = (("BSD-2-Clause", "BSD-3-Clause"),)


def notice(spdx: str) -> str:
    """Identifier of a sentence that names a licence."""
    return f"notice_{spdx.lower()}"


def declared(spdx: str) -> str:
    """Identifier of an SPDX line that holds a licence."""
    return f"spdx_{spdx.lower()}"


def spdx_ids() -> dict[str, str]:
    """Lower-case SPDX identifiers, with their suffixes, to the licence."""
    return {f"{spdx.lower()}{end}": spdx for spdx, _ in NAMES for end in ("", "-only", "-or-later", "+")}


def names() -> dict[str, str]:
    """All names to the identifiers of their notices: those above, and for "x version n" also the other
    ways to say it."""
    out = {}
    for spdx, several in NAMES:
        for name in (x.replace("licence", "license") for x in several):
            out[name] = notice(spdx)
            if m := re.fullmatch(r"(.*) version ([0-9 ]+)", name):
                what, n = m.groups()
                ways = [f"{what} either version {n}", f"{what} {n}", f"version {n} of the {what}", f"version {n} or later of the {what}", f"version {n} or any later version of the {what}"]
                for way in ways + [f"{what} version {n} 0"] * n.isdigit():
                    out.setdefault(way, notice(spdx))
    return out


def rules() -> dict[str, list[tuple[str, ...]]]:
    """All rules of each licence: one notice, one SPDX line, or those above."""
    out = {spdx: [(notice(spdx),), (declared(spdx),)] for spdx, _ in NAMES}
    for spdx, rule in RULES:
        out[spdx].append(rule)
    return out


def _any(several) -> str:
    """One of some phrases, the longest first, told apart by their first words at once."""
    by: dict[str, list[str]] = {}
    for phrase in sorted(several, key=len, reverse=True):
        first, _, rest = phrase.partition(" ")
        by.setdefault(first, []).append(f" {rest}" if rest else "")
    return f"(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in by.items())})"


def _list(several, stop: str, more: str) -> str:
    one = f"{_any(several)}{_LATER}{stop}"
    return f"{one}(?:{_JOIN} {one}){more}"


def name() -> str:
    """A regular expression for any name."""
    return _any(names())


def title(stop: str = "", more: str = "*") -> str:
    """What is evidence if it is a whole sentence: names of licences, joined.  ``stop`` is what a name
    must be followed by, ``more`` the repetition of further names, where an engine has better forms."""
    return f"(?:the )?{_list([x for x in names() if 'license' in x and x != BARE], stop, more)}(?: {BARE})?"


def known(stop: str = "", more: str = "*") -> str:
    """A regular expression for all notices and sentences."""
    return f"{LEAD} {_list(names(), stop, more)}|(?:(?:not|non|never|t) )?{name()} licensed|{_any(SENTENCES)}"


#: Rewriting, before the text is cut, with the groups kept: a field of a licence becomes a sentence (its
#: value, a line's rest of up to 48 characters, ends it), and a bare "MIT" the name that stands for it.
END = "\u0002"
FIELD = (r"license[\"']?[\x20\t]*[:=][\x20\t]*([^\n]{1,48})(\n|\z)", (" license is ", 1, f" {END}", 2))
BARE_MIT = (
    rf"([^\p{{L}}\p{{N}}]|\A)mit([\x20\t]*[.,;:)/\"'\n{END}]|[\x20\t]*\z|[\x20\t-]+licensed|[\x20\t]+or[\x20\t\n]|[\x20\t]+and[\x20\t\n])",
    (1, BARE, 2),
)


def written(parts, sign: str) -> str:
    """A replacement of text and numbers of groups; ``sign`` leads a group."""
    return "".join(f"{sign}{x}" if isinstance(x, int) else x for x in parts)
