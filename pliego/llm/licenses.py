"""Licence recognition by sentences and rules.

A text becomes a row of normalised words with borders between sentences: blank lines and list items are hard borders; ends of
lines, and full stops, colons and semicolons before white space, are soft ones, which a sentence may also run across, as texts
wrap and "v. 2.0" holds a full stop. What stands from border to border and equals a known licence sentence, names and years left
open, is mapped to that sentence's identifier; a notice that names licences and says nothing else, to one for each, and if it denies them to none. The identifiers, in the
order of the text, are then matched against ordered rules, the longest first; a rule consumes the identifiers that it matches,
and what no rule consumes is reported as unmatched. A licence that is only named within other words is mentioned, not granted.
SPDX tags are read as expressions. Everything is DataFrame functions; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of the licences' own texts and standard notices. <> stands for up to GAP words, such as names.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL <> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "x11-names": "Except as contained in this notice, the name of <> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <>",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND <> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "isc-liability": "IN NO EVENT SHALL <> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "Neither the name of <> may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author-name": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY <> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-liability": "IN NO EVENT SHALL <> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "unlicense-dedication": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "unlicense-benefit": "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    "unlicense-intent": "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "bsl-notice": "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",
    "wtfpl-verbatim": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "asf-licensed": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-definitions": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache-patent": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    "gnu-hope": "<> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gnu-see": "See the GNU General Public License for more details",
    "gnu-see-lesser": "See the GNU Lesser General Public License for more details",
    "gnu-see-affero": "See the GNU Affero General Public License for more details",
    "gnu-copy": "You should have received a copy of the GNU General Public License along with <>",
    "gnu-copy-lesser": "You should have received a copy of the GNU Lesser General Public License along with <>",
    "gnu-copy-affero": "You should have received a copy of the GNU Affero General Public License along with <>",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-copy-url": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc0-waiver": "To the extent possible under law, <> has waived all copyright and related or neighboring rights to <>",
    "ofl-font": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "rights-reserved": "All rights reserved",
}

#: Sentences that say the same as another one.
SAME = {
    "isc-grant-and": "isc-grant", "bsd-author-name": "bsd-names", "apache-copy-url": "apache-copy", "apache-copy-https": "apache-copy", "gnu-see-lesser": "gnu-see", "gnu-see-affero": "gnu-see",
    "gnu-copy-lesser": "gnu-copy", "gnu-copy-affero": "gnu-copy", "mpl-copy-url": "mpl-copy", "mpl-copy-https": "mpl-copy",
}

#: Licences and the sentence sequences that state them. `notice:` is a notice or title that names the licence.
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("X11", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability", "x11-names"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is", "mit-liability"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-as-is", "isc-liability"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone", "unlicense-dedication", "unlicense-benefit", "unlicense-intent", "mit-as-is", "mit-liability"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone", "unlicense-dedication", "unlicense-benefit", "unlicense-intent"]),
    ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["bsl-grant", "bsl-notice"]),
    ("WTFPL", ["wtfpl-verbatim"]),
    ("Apache-2.0", ["asf-licensed", "asf-notice", "notice:Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["asf-licensed", "asf-notice", "notice:Apache-2.0"]),
    ("Apache-2.0", ["notice:Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["notice:Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["notice:Apache-2.0", "apache-definitions", "apache-patent"]),
    ("Apache-2.0", ["apache-definitions", "apache-patent"]),
    ("MPL-2.0", ["notice:MPL-2.0", "mpl-copy"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("OFL-1.1", ["ofl-font"]),
    *((name, [f"notice:{name}", *rest]) for name in (
        "GPL-2.0", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-or-later"
    ) for rest in (["gnu-hope", "gnu-see", "gnu-copy"], ["gnu-hope", "gnu-copy"], ["gnu-hope", "gnu-see"], ["gnu-verbatim"])),
]

_GNU = r"(?:gnu )?{}(?: [a]?l?gpl)?(?: as published by the free software foundation)?(?: either)?(?: version | ?v ?| )?{}(?: [0-9]+ [a-z]+ [0-9]{{4}})?"
_GNU_NAMES = {"GPL": ("general public license", "gpl"), "LGPL": ("(?:lesser|library) general public license", "lgpl"), "AGPL": ("affero general public license", "agpl")}
_LATER = r"(?: of the license| only)??(?: or at your option| or)(?: any)? (?:later(?: version)?|newer(?: version)?)"
_CC = r"(?:creative commons attribution{} {v}(?: international| unported)?(?: public)?(?: license)?|cc by{} {v}(?: international| unported)?(?: license)?)"
_CC_KINDS = {
    "BY-NC-SA": (" non ?commercial share ?alike", " nc sa"), "BY-NC-ND": (" non ?commercial no ?deriv(?:ative)?s", " nc nd"), "BY-NC": (" non ?commercial", " nc"),
    "BY-ND": (" no ?deriv(?:ative)?s", " nd"), "BY-SA": (" share ?alike", " sa"), "BY": ("", "")
}

#: How licences are named, as patterns over normalised words.
NAMES = {
    **{
        f"{k}-{v}.0-or-later" if "." not in v else f"{k}-{v}-or-later": "(?:" + "|".join(_GNU.format(n, v.replace(".", r"\.") + ("" if "." in v else r"(?:\.0)?")) for n in _GNU_NAMES[k]) + ")" + _LATER for k,
        v in (("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"), ("GPL", "2"), ("GPL", "3"))
    },
    **{
        f"{k}-{v}.0" if "." not in v else f"{k}-{v}": "(?:" + "|".join([_GNU.format(n, v.replace(".", r"\.") + ("" if "." in v else r"(?:\.0)?")) for n in _GNU_NAMES[k]] + [f"version {v.replace('.', chr(92) + '.')} of the gnu {_GNU_NAMES[k][0]}"]) + ")(?: only)?(?: license)?" for k,
        v in (("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"), ("GPL", "2"), ("GPL", "3"))
    },
    "Apache-2.0": r"apache(?: software)?(?: license)?(?: version | v ?| )2(?:\.0)?(?: license)?(?: january 2004)?",
    "MIT": r"(?:mit|expat)(?: x11)? license",
    "BSD-3-Clause": r"(?:(?:3|three) clause|new|modified|revised) bsd license|bsd (?:3|three) clause(?: new or revised)?(?: license)?",
    "BSD-2-Clause": r"(?:(?:2|two) clause|simplified|freebsd) bsd license|bsd (?:2|two) clause(?: simplified)?(?: license)?",
    "ISC": r"isc license",
    "Zlib": r"zlib(?: libpng)? license",
    "BSL-1.0": r"boost software license(?: version| v)? 1\.0(?: august 17th 2003)?",
    "MPL-2.0": r"(?:mozilla public license|mpl)(?: version | v ?| )2(?:\.0)?",
    "EPL-2.0": r"(?:eclipse public license|epl)(?: version | v ?| )2(?:\.0)?",
    "EPL-1.0": r"(?:eclipse public license|epl)(?: version | v ?| )1(?:\.0)?",
    "EUPL-1.2": r"(?:european union public license|eupl)(?: version | v ?| )1\.2",
    "CDDL-1.0": r"(?:common development and distribution license|cddl)(?: version | v ?| )1\.0",
    "OFL-1.1": r"(?:sil open font license|ofl)(?: version | v ?| )1\.1",
    "Unlicense": r"unlicense",
    "WTFPL": r"do what the fuck you want to public license|wtfpl",
    "PostgreSQL": r"postgresql license",
    **{f"CC-{k}-{v}": _CC.format(*words, v=v.replace(".", r"\.")) for v in ("4.0", "3.0") for k, words in _CC_KINDS.items()},
    "CC0-1.0": r"cc0(?: version| v)?(?: 1\.0)?(?: universal)?(?: public domain dedication)?",
    "Artistic-2.0": r"artistic license(?: version | v ?| )2(?:\.0)?",
    "PSF-2.0": r"(?:python software foundation|psf|python)(?: software foundation)? license(?: agreement)?(?:(?: version | v ?| )2(?:\.0)?)?(?: for python [0-9.]+)?",
    # a notice without a version allows any
    "LGPL-2.0-or-later": r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: lgpl| license)?",
    "AGPL-1.0-or-later": r"(?:gnu )?(?:affero general public license|agpl)(?: agpl| license)?",
    "GPL-1.0-or-later": r"(?:gnu )?(?:general public license|gpl)(?: gpl| license)?",
}

#: Names that only count as such below a heading or after "License:".
BARE = {"MIT": "mit|expat", "ISC": "isc", "Zlib": "zlib", "BSD-3-Clause": "bsd 3 clause", "BSD-2-Clause": "bsd 2 clause", "Unlicense": "the unlicense"}

#: What may stand around a licence's name in a notice that says nothing else.
BEFORE = r"(?:(?:<line>)?licenses (?:this|the) (?:file|work|software|code|project|program)(?: to you)? under (?:the )?|(?:<line>)?(?:(?:is|are|was|were|be) )?(?:hereby )?(?:dual )?(?:licensed|released|distributed|available|made available|provided|published|offered|covered|governed)(?: to you)?(?: as open source)? (?:under|by)(?: the terms(?: and conditions)? of)?(?: either of| either| any of| both)?(?: the| a| an)? |(?:<>)?you can redistribute it and or modify it under the terms of the |(?:<line>)?subject to the terms of the |under(?: the terms of)? the |license |the )?"
AFTER = r"(?: the license| license| only)?(?: which (?:is available|accompanies)(?: [a-z0-9.+]+){0,16})?"

MORE = r"(?: and or| and| or)(?: under)?(?: the| a| an| either)? "
CHOICE = r"(?: at your (?:option|choice|discretion))?"

#: Words with which a notice grants nothing. What is said where nothing else is stated is no such word.
DENIED = r" (?:not|never|neither|nor|none|cannot|no longer|no part|isn|aren|wasn|weren|doesn|don|didn|won|couldn|shouldn|wouldn|if|whether|until|formerly|previously|would|could|instead of|rather than|unlike|is it|are they) "
OTHERWISE = r" (?:unless|except where|except as|if not|where not)(?: explicitly| expressly)? otherwise (?:noted|stated|specified|indicated|mentioned) "
#: A link as Markdown writes it, of which its text is read.
LINK = r"\[([^\]\n]+)\]\([^)\n]*\)"

GAP = 16
_WORD = "[a-z0-9.+]+"
_SEP = "(?: |//|~~)"
_GAP = rf"(?:{_WORD}{_SEP}){{0,{GAP}}}?"
_GAP_IN_LINE = rf"(?:{_WORD}(?: |//)){{0,{GAP}}}?"

#: A text without any of these, in small letters, holds no known sentence.
HINTS = [
    "license", "licence", "permission", "redistribut", "warrant", "liable", "public domain", "all rights reserved", "spdx", "cc by", "cc-by", "cc0", "gpl", "advertising",
    "endorse", "misrepresented", "this notice", "this software", "dedication", "rights to", "mpl", "copyright"
]

#: What stands before a line's own text in comments, and a mark of a list item.
LEAD = r"\n[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+)?[ \t]*"
ITEM = r"\n(?:\(?[0-9a-z]{1,2}[.)]|[-o•])[ \t]+"
STOP = r"""[.!?;:]["'”’)\]]{0,3}(?: ?\n| )"""

#: A tag with a licence expression.
_SPDX_ID = r"\(*[A-Za-z0-9]+(?:[.:-]+[A-Za-z0-9]+)*\+?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_SPDX_ID}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{_SPDX_ID})*)"


def words(text: str) -> str:
    """A known sentence as `stream` would write it within its borders; soft borders inside as spaces."""
    plain = text.lower().replace("licence", "license").replace("/", " ")
    plain = re.sub(r"[.!?;:]+[\"')]*(?=\s|$)", " ", plain)
    return " ".join(re.sub(r"[^a-z0-9.+<>]+", " ", plain).split())


def _pattern(sentence: str) -> str:
    return _spaced(re.escape(words(sentence)).replace("\\ ", " ").replace("<> ", "<>").replace(" <>", " <>"))


def _spaced(pattern: str) -> str:
    """A pattern over words as one over a stream: a space may be a soft border, <> some words, <line> some before a full stop."""
    last = re.sub(r" <>$", rf"(?: {_WORD}){{0,{GAP}}}", pattern)
    parts = re.split("(<>|<line>)", last)
    spaced = [p.replace(" ?", "\0").replace(" ", _SEP).replace("\0", f"{_SEP}?") for p in parts]
    return "".join({"<>": _GAP, "<line>": _GAP_IN_LINE}.get(p, p) for p in spaced)


#: Identifier and pattern of each sentence; where two fit at one place the first counts.
KNOWN = [(i, _pattern(s)) for i, s in sorted(SENTENCES.items(), key=lambda p: -len(p[1]))]
_ONE = f"(?:{'|'.join(NAMES.values())}){AFTER}"
#: A notice that names one licence or several; and a heading with a licence below it.
NOTICE = _spaced(f"{BEFORE}{_ONE}(?:{MORE}{_ONE}){{0,3}}{CHOICE}")
HEADED = rf"(?:project )?license(?:\|\||//|~~)(?:the )?(?:{_spaced(_ONE)}|{'|'.join(_spaced(p) for p in BARE.values())})"
FRONT = "^(?:" + _spaced(BEFORE.removesuffix("?")) + ")"
ANY = "[|/~](?:" + "|".join([*(p for _, p in KNOWN), NOTICE, HEADED]) + ")[|/~]"
#: Names in what is left of a text, or within a notice; and their identifiers.
CALLED = [(n, _spaced(p)) for n, p in NAMES.items()]
NAMED = "[ |/~](?:" + "|".join(f"(?:{p})" for _, p in CALLED) + ")[ |/~]"
CALLED_BARE = CALLED + [(n, _spaced(f"(?:{p})")) for n, p in BARE.items()]
NAMED_BARE = "[ |/~](?:" + "|".join(f"(?:{p})" for _, p in CALLED_BARE) + ")[ |/~]"
_ALL_RULES = sorted([*RULES, *((name, [f"notice:{name}"]) for name in NAMES)], key=lambda r: -len(r[1]))
RULE = "|".join("".join(f";{i};" for i in sequence).replace(".", r"\.").replace("+", r"\+") for _, sequence in _ALL_RULES)
BY_SEQUENCE = {"".join(f";{i};" for i in sequence): name for name, sequence in _ALL_RULES}


def stream(text: Column) -> Column:
    """The whole text as normalised words. || is a hard border, ~~ a full stop or the like, // an end of line; begins and ends with ||."""
    sub = F.regexp_replace
    text = sub(text, LINK, "$1")
    plain = F.concat(F.lit("\n"), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"))
    plain = sub(sub(plain, LEAD, "\n"), ITEM, "\n\n")
    plain = F.replace(F.lower(F.translate(plain, "|/~", "   ")), F.lit("licence"), F.lit("license"))
    plain = sub(sub(sub(plain, r"[ \t]+", " "), r"\n\n+", "\n|"), STOP, "~")
    plain = sub(sub(F.replace(plain, F.lit("\n"), F.lit("/")), r"[^a-z0-9.+|/~]+", " "), r" ?/[ /]*", "/")
    plain = sub(sub(F.concat(F.lit("|"), plain, F.lit("|")), r"[ /]?~[ /~]*", "~"), r"[ /~]?\|[ /~|]*", "|")
    for border in "|/~":
        plain = F.replace(plain, F.lit(border), F.lit(border * 2))
    return plain


def hinted(text: Column) -> Column:
    return reduce(Column.__or__, [F.lower(text).contains(h) for h in HINTS])


def first_fit(text: Column, known: list[tuple[str, str]]) -> Column:
    """The first name whose pattern is the whole text."""
    return reduce(lambda rest, k: F.when(text.rlike(f"^(?:{k[1]})$"), F.lit(k[0])).otherwise(rest), reversed(known), F.lit(None).cast("string"))


def tagged(text: Column) -> Column:
    """The licences that the text's SPDX tags name, exceptions left out; + is written as -or-later."""
    said = F.regexp_extract_all(text, F.lit(f"(?i){SPDX}"), F.lit(1))
    plain = F.transform(said, lambda e: F.regexp_replace(F.regexp_replace(e, r"[()]", " "), r"(?i)[ \t]+WITH[ \t]+[^ \t]+", ""))
    parts = F.transform(F.flatten(F.transform(plain, lambda e: F.split(e, r"(?i)[ \t]+(?:AND|OR)[ \t]+"))), lambda p: F.trim(p))
    known = {n.lower(): n for n in NAMES}
    cased = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    later = F.transform(parts, lambda p: F.regexp_replace(p, r"\+$", "-or-later"))
    return F.transform(later, lambda p: F.coalesce(F.try_element_at(cased, F.lower(p)), p))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, sentence_ids, licenses, mentioned and unmatched (arrays of strings) of every whole text, one row for each row of docs.

    sentence_ids keeps the order of the text and repeats; licenses (granted, or said by a tag) and mentioned (only named) are
    sorted, each once; unmatched keeps order. Texts that are null, empty or without a known sentence or name have empty arrays.
    Null and repeated ids stay; other columns, whatever their names, are left out; an empty table gives an empty one.
    """
    none = F.array().cast("array<string>")
    known = [(SAME.get(i, i), p) for i, p in KNOWN]
    inside = lambda m: F.substring(m, 2, 1 << 30)
    inner = lambda m: inside(F.reverse(inside(F.reverse(m))))
    padded = lambda m: F.concat(F.lit(" "), m, F.lit(" "))
    some = hinted(F.coalesce(F.col(text_col), F.lit("")))
    untagged = F.regexp_replace(F.col(text_col), f"(?i){SPDX}", "\n\n")
    found = docs.select(F.col(id_col).alias("id"), F.when(some, F.col(text_col)).alias("text"), F.when(some, stream(untagged)).alias("stream"))
    matched = F.transform(F.regexp_extract_all("stream", F.lit(ANY), F.lit(0)), lambda m: F.struct(inner(m).alias("said"), first_fit(inner(m), known).alias("id")))
    found = found.withColumn("matched", F.coalesce(matched, F.array().cast("array<struct<said:string,id:string>>")))

    def denied(said: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(padded(said), "[|/~]+", " "), OTHERWISE, " ").rlike(DENIED)

    def named(said: Column) -> Column:
        names = F.regexp_extract_all(padded(F.regexp_replace(said, FRONT, "")), F.lit(NAMED_BARE), F.lit(0))
        return F.array_compact(F.transform(names, lambda n: F.concat(F.lit("notice:"), first_fit(inner(n), CALLED_BARE))))

    ids = F.flatten(F.transform("matched", lambda m: F.when(m["id"].isNotNull(), F.array(m["id"])).when(denied(m["said"]), none).otherwise(named(m["said"]))))
    refused = F.filter("matched", lambda m: m["id"].isNull() & denied(m["said"]))
    rest = F.concat(F.regexp_replace("stream", ANY, "||"), F.array_join(F.transform(refused, lambda m: F.concat(F.lit("|"), m["said"], F.lit("|"))), ""))
    names = F.regexp_extract_all(rest, F.lit(NAMED), F.lit(0))
    found = found.select(
        "id",
        ids.alias("sentence_ids"),
        F.coalesce(tagged(F.col("text")), none).alias("tags"),
        F.coalesce(F.array_compact(F.transform(names, lambda m: first_fit(inner(m), CALLED))), none).alias("names"),
    )
    # ";" on both sides of every identifier, so that a consumed sequence leaves a border where it stood
    row = F.concat(F.lit(";"), F.array_join("sentence_ids", ";;"), F.lit(";"))
    by_sequence = F.create_map(*[F.lit(x) for pair in BY_SEQUENCE.items() for x in pair])
    granted = F.transform(F.regexp_extract_all(row, F.lit(RULE), F.lit(0)), lambda s: by_sequence[s])
    granted = F.array_sort(F.array_distinct(F.concat(granted, "tags")))
    left = F.filter(F.split(F.regexp_replace(row, RULE, "|"), "[;|]+"), lambda s: s != "")
    return found.select(F.col("id").alias(id_col), "sentence_ids", granted.alias("licenses"), F.array_sort(F.array_except("names", granted)).alias("mentioned"), left.alias("unmatched"))
