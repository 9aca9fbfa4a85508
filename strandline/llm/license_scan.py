"""License scans: ordered signature rules gated by a keyword automaton, overlaps resolved by priority and interval containment."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Rule:
    """A signature over words in lower case with one space between them: pattern is tried only where keyword stands in the text,
    so whatever pattern matches has to hold keyword.

    weight, 0 to 1: how sure a match is. Larger priority wins.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: Families: label's stem, keyword (a name without it is its own), names as patterns, versions as words with their label suffixes.
_FAMILIES = (
    ("apache", "apache", ("apache", "apache software foundation"), {"1 0": "1.0", "1 1": "1.1", "2 0": "2.0", "2": "2.0"}),
    ("gpl", "gpl", ("gpl", "gnu gpl"), {"1": "1.0", "2": "2.0", "2 0": "2.0", "3": "3.0", "3 0": "3.0"}),
    ("gpl", "general public license", ("gnu general public license", "general public license"), {"1": "1.0", "2": "2.0", "2 0": "2.0", "3": "3.0", "3 0": "3.0"}),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), {"2": "2.0", "2 0": "2.0", "2 1": "2.1", "3": "3.0", "3 0": "3.0"}),
    ("lgpl", "lesser general public license", ("gnu lesser general public license", "lesser general public license"), {"2 1": "2.1", "3": "3.0", "3 0": "3.0"}),
    ("lgpl", "library general public license", ("gnu library general public license", "library general public license"), {"2": "2.0", "2 0": "2.0"}),
    ("agpl", "agpl", ("agpl", "gnu agpl"), {"1": "1.0", "3": "3.0", "3 0": "3.0"}),
    ("agpl", "affero general public license", ("gnu affero general public license", "affero general public license"), {"1": "1.0", "3": "3.0", "3 0": "3.0"}),
    ("gfdl", "free documentation license", ("gnu free documentation license", "free documentation license"), {"1 1": "1.1", "1 2": "1.2", "1 3": "1.3"}),
    ("mpl", "mpl", ("mpl",), {"1 0": "1.0", "1 1": "1.1", "2 0": "2.0"}),
    ("mpl", "mozilla public license", ("mozilla public license",), {"1 0": "1.0", "1 1": "1.1", "2 0": "2.0"}),
    ("epl", "eclipse public license", ("eclipse public license",), {"1 0": "1.0", "2 0": "2.0"}),
    ("eupl", "european union public licence", ("european union public licence",), {"1 0": "1.0", "1 1": "1.1", "1 2": "1.2"}),
    ("cddl", "common development and distribution license", ("common development and distribution license",), {"1 0": "1.0", "1 1": "1.1"}),
    ("artistic", "artistic license", ("artistic license",), {"1 0": "1.0", "2 0": "2.0"}),
    ("afl", "academic free license", ("academic free license",), {"2 1": "2.1", "3 0": "3.0"}),
    ("osl", "open software license", ("open software license",), {"2 1": "2.1", "3 0": "3.0"}),
    ("lppl", "latex project public license", ("latex project public license",), {"1 0": "1.0", "1 3c": "1.3c"}),
    ("odbl", "open database license", ("open database license",), {"1 0": "1.0"}),
    ("bsl", "boost software license", ("boost software license",), {"1 0": "1.0"}),
    ("zpl", "zope public license", ("zope public license",), {"2 0": "2.0", "2 1": "2.1"}),
    ("ofl", "open font license", ("sil open font license", "open font license"), {"1 0": "1.0", "1 1": "1.1"}),
    ("python", "python software foundation license", ("python software foundation license",), {"2": "2.0"}),
    ("mit", "mit", ("mit", "mit x11", "expat"), {}),
    ("isc", "isc", ("isc", "internet systems consortium"), {}),
    ("zlib", "zlib", ("zlib", "zlib libpng"), {}),
    ("unlicense", "unlicense", ("unlicense",), {}),
    ("wtfpl", "do what the f", ("do what the fuck you want to public",), {}),
)
#: Creative Commons: elements, their words, and versions.
_CC = {"by": ("by", "attribution"), "by-sa": ("by sa", "attribution share ?alike"), "by-nd": ("by nd", "attribution no ?deriv(?:s|atives)"), "by-nc": ("by nc", "attribution non ?commercial"), "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"), "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)")}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Single signatures: label, keyword, pattern, priority, weight.
_SINGLE = (
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", 80, 0.95),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)(?: license)?", 80, 0.95),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", 80, 0.95),
    ("bsd-0-clause", "bsd", r"(?:0bsd|zero clause bsd)(?: license)?", 80, 0.95),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]ed?", 40, 0.7),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 60, 0.9),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without (?:specific )?prior written permission", 70, 0.9),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 90, 1.0),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 90, 1.0),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation", 70, 0.95),
    ("lgpl", "free software foundation", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", 75, 0.95),
    ("agpl", "free software foundation", r"under the terms of the gnu affero general public license as published by the free software foundation", 75, 0.95),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 70, 0.9),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v?1 0)?", 70, 0.9),
    ("public-domain", "public domain", r"(?:released into|placed in|dedicated to|is in) the public domain", 50, 0.8),
    ("public-domain-mark", "public domain mark", r"public domain mark(?: 1 0)?", 60, 0.9),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary", 50, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){0,6} (?:strictly )?prohibited", 50, 0.8),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|redistributed)(?: \S+){0,8} without(?: \S+){0,4} permission", 45, 0.7),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)*", 30, 0.5),
    ("copyright", "copyright", r"(?:19|20)\d\d(?: \S+){0,5} copyright|copyright(?: \S+){1,5} (?:19|20)\d\d", 25, 0.4),
    ("license-reference", "licen", r"(?:see|read)(?: the)? (?:accompanying )?(?:file )?licen[sc]e(?: (?:file|txt|md))? for(?: \S+){0,3} details", 20, 0.3),
    ("apache-2.0", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 85, 0.95),
    ("apache-2.0", "on an as is basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", 65, 0.8),
    ("apache-2.0", "apache org licenses license 2 0", r"(?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?", 85, 0.95),
    ("apache-1.1", "developed by the apache software foundation", r"this product includes software developed by the apache software foundation", 75, 0.8),
    ("mit", "opensource org licenses mit", r"(?:http|https) (?:www )?opensource org licenses mit(?: license)?(?: php)?", 85, 0.95),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 75, 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?", 85, 0.9),
    ("mit-modern", "modern variant", r"mit license modern variant", 85, 0.8),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 85, 0.9),
    ("bsd", "neither the name of", r"neither the name of(?: the)?(?: \S+){1,12} nor the names of its contributors may be used to endorse or promote products", 72, 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 78, 0.95),
    ("bsd-2-clause", "in no event shall", r"in no event shall the (?:regents or contributors|copyright (?:holder|owner)s? or contributors) be liable", 35, 0.5),
    ("bsd-2-clause", "freebsd", r"(?:the )?freebsd (?:license|project license|documentation license)", 70, 0.8),
    ("bsd-3-clause-clear", "clear bsd", r"clear bsd(?: license)?", 85, 0.9),
    ("bsd-patent", "bsd 2 clause plus patent", r"bsd 2 clause plus patent(?: license)?", 90, 0.95),
    ("isc", "above copyright notice and this permission notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies", 65, 0.8),
    ("gpl", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 68, 0.85),
    ("lgpl", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", 69, 0.85),
    ("agpl", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details", 69, 0.85),
    ("gpl", "you should have received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this (?:program|library|file|package)", 68, 0.9),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with this (?:program|library|file|package)", 69, 0.9),
    ("gpl", "gnu org licenses gpl", r"(?:http|https) (?:www )?gnu org licenses gpl(?: \d \d)?(?: html| txt| en html)?", 80, 0.9),
    ("lgpl", "gnu org licenses lgpl", r"(?:http|https) (?:www )?gnu org licenses lgpl(?: \d \d)?(?: html| txt| en html)?", 80, 0.9),
    ("agpl", "gnu org licenses agpl", r"(?:http|https) (?:www )?gnu org licenses agpl(?: \d \d)?(?: html| txt| en html)?", 80, 0.9),
    ("gfdl", "gnu org licenses fdl", r"(?:http|https) (?:www )?gnu org licenses fdl(?: \d \d)?(?: html| txt)?", 80, 0.9),
    ("gpl-classpath-exception", "classpath exception", r"(?:with (?:the )?)?classpath exception", 70, 0.8),
    ("gpl-linking-exception", "linking this library statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work", 80, 0.9),
    ("gpl-font-exception", "with font exception", r"gpl(?: \S+){0,3} with font exception", 80, 0.8),
    ("gpl-bison-exception", "bison", r"special exception(?: \S+){0,20} larger work that contains part or all of the bison parser skeleton", 80, 0.9),
    ("gcc-exception", "gcc runtime library exception", r"gcc runtime library exception(?: version)?(?: 3 1)?", 80, 0.9),
    ("mpl-2.0", "mozilla public license v 2 0", r"this source code form is subject to the terms of the mozilla public license v 2 0", 92, 1.0),
    ("mpl-2.0", "mozilla org mpl 2 0", r"(?:http|https) (?:www )?mozilla org mpl 2 0", 85, 0.95),
    ("mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1", 92, 1.0),
    ("cddl-1.0", "cddl", r"cddl(?: version)? 1 0", 80, 0.9),
    ("cddl", "common development and distribution license", r"subject to the terms of the common development and distribution license", 70, 0.9),
    ("epl-1.0", "eclipse public license v1 0", r"(?:terms of the )?eclipse public license v1 0 which accompanies this distribution", 92, 0.95),
    ("epl-2.0", "eclipse org", r"(?:http|https) (?:www )?eclipse org (?:org )?(?:legal epl|documents epl) (?:v20|2 0)(?: html| txt)?", 85, 0.95),
    ("cpl-1.0", "common public license", r"common public license(?: version)?(?: v? ?1 0)?", 75, 0.9),
    ("ipl-1.0", "ibm public license", r"ibm public license(?: version)?(?: v? ?1 0)?", 75, 0.9),
    ("eupl", "eupl", r"(?:licensed under the )?eupl(?: v? ?1 [012])?", 75, 0.9),
    ("ofl-1.1", "scripts sil org ofl", r"(?:http|https) (?:www )?scripts sil org ofl", 85, 0.95),
    ("ofl", "reserved font name", r"with reserved font names?(?: \S+){0,4}", 60, 0.8),
    ("ms-pl", "microsoft public license", r"(?:the )?microsoft public license(?: ms pl)?", 80, 0.95),
    ("ms-rl", "microsoft reciprocal license", r"(?:the )?microsoft reciprocal license(?: ms rl)?", 80, 0.95),
    ("ms-eula", "microsoft software license terms", r"microsoft software license terms", 70, 0.9),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 80, 0.95),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 80, 0.95),
    ("libpng", "libpng", r"(?:the )?libpng license", 80, 0.9),
    ("libpng", "png reference library", r"(?:the )?png reference library license", 80, 0.9),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 85, 1.0),
    ("unlicense", "unlicense org", r"(?:http|https) (?:www )?unlicense org", 85, 0.95),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", 80, 0.9),
    ("beerware", "beer", r"(?:the )?beer ?ware license|buy me a beer in return", 80, 0.9),
    ("postgresql", "postgresql license", r"(?:the )?postgresql license", 80, 0.9),
    ("postgresql", "without a written agreement is hereby granted", r"for any purpose without fee and without a written agreement is hereby granted", 78, 0.9),
    ("ntp", "ntp license", r"(?:the )?ntp license", 75, 0.8),
    ("curl", "curl license", r"(?:the )?curl license", 75, 0.8),
    ("openssl", "openssl", r"this product includes software developed by the openssl project|(?:the )?openssl license", 80, 0.9),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 80, 0.9),
    ("php", "php", r"(?:the )?php license(?: version)?(?: v?3 01?)?|this product includes php software", 75, 0.9),
    ("ruby", "ruby license", r"(?:the )?ruby license|same (?:terms|license) as ruby license", 70, 0.8),
    ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?(?: \d)?", 75, 0.9),
    ("vim", "vim license", r"(?:the )?vim license", 75, 0.9),
    ("w3c", "w3c", r"w3c (?:software (?:notice and|and document) )?license", 75, 0.9),
    ("unicode", "unicode", r"unicode license(?: agreement)?(?: v3)?|unicode inc license agreement", 75, 0.9),
    ("icu", "icu license", r"icu license", 75, 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 90, 1.0),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group", 80, 0.95),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?license", 80, 0.95),
    ("tcl", "tcl", r"tcl tk license|tcl license", 75, 0.8),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license", 80, 0.95),
    ("upl-1.0", "universal permissive license", r"universal permissive license(?: upl)?(?: version)?(?: v? ?1 0)?", 80, 0.95),
    ("ecl-2.0", "educational community license", r"educational community license(?: version)?(?: 2 0)?", 80, 0.95),
    ("cecill", "cecill", r"cecill(?: (?:b|c))?(?: (?:version )?\d(?: \d)?)?(?: licen[sc]e)?", 75, 0.9),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: v2)?", 80, 0.95),
    ("bsl-business", "business source license", r"business source license(?: 1 1)?", 80, 0.95),
    ("sspl-1.0", "server side public license", r"server side public license(?: sspl)?(?: (?:version|v))?(?: ?1)?", 80, 0.95),
    ("elastic-2.0", "elastic license", r"elastic license(?: (?:version )?2 0)?", 80, 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?(?: v1 0)?", 80, 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)(?: license)?(?: 1 0 0)?", 80, 0.95),
    ("llama", "llama", r"llama \d(?: \d)? community license(?: agreement)?", 85, 0.95),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?", 80, 0.9),
    ("rail", "responsible ai license", r"responsible ai license(?: v\d)?", 75, 0.9),
    ("odc-by", "open data commons attribution", r"open data commons attribution(?: license)?(?: v?1 0)?", 80, 0.95),
    ("pddl", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license(?: pddl)?", 80, 0.95),
    ("odbl", "open data commons open database", r"open data commons open database license(?: odbl)?", 82, 0.95),
    ("cdla-permissive", "community data license agreement", r"community data license agreement permissive(?: (?:version )?\d 0)?", 82, 0.95),
    ("cdla-sharing", "community data license agreement", r"community data license agreement sharing(?: (?:version )?1 0)?", 82, 0.95),
    ("ogl-uk", "open government licence", r"open government licence(?: (?:v|version )?[123](?: 0)?)?", 80, 0.95),
    ("etalab", "etalab", r"licence ouverte(?: \S+){0,2} etalab|etalab(?: \S+){0,2} licence", 75, 0.9),
    ("dl-de", "datenlizenz deutschland", r"datenlizenz deutschland (?:namensnennung|zero)(?: (?:version )?2 0)?", 80, 0.95),
    ("cc", "some rights reserved", r"some rights reserved", 30, 0.4),
    ("cc", "creative commons", r"(?:licensed under a |under a )?creative commons licen[sc]e", 40, 0.6),
    ("cc0-1.0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", 90, 1.0),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 80, 0.9),
    ("public-domain-mark", "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", 90, 1.0),
    ("public-domain", "no known copyright", r"no known copyright restrictions?", 55, 0.7),
    ("public-domain", "work of the u s government", r"(?:is )?(?:a )?work of the u s government", 50, 0.7),
    ("public-domain", "gemeinfrei", r"gemeinfrei(?:e|es|er|en)?", 45, 0.6),
    ("public-domain", "domaine public", r"(?:dans le|du) domaine public", 45, 0.6),
    ("public-domain", "dominio p", r"(?:en el|de) dominio p\S{1,3}blico", 45, 0.6),
    ("reserved-de", "alle rechte vorbehalten", r"alle rechte vorbehalten", 50, 0.8),
    ("reserved-fr", "tous droits r", r"tous droits r\S+serv\S+s", 50, 0.8),
    ("reserved-es", "todos los derechos reservados", r"todos los derechos reservados", 50, 0.8),
    ("proprietary", "trade secret", r"(?:contains|constitutes?)(?: \S+){0,6} trade secrets?(?: \S+){0,4}", 45, 0.6),
    ("proprietary", "proprietary information of", r"(?:confidential )?(?:and )?proprietary information of(?: \S+){1,3}", 45, 0.7),
    ("proprietary", "no part of this", r"no part of this (?:publication|work|book|document|site|website) may be (?:reproduced|stored|copied|transmitted|distributed)", 55, 0.8),
    ("proprietary", "do not distribute", r"(?:internal use only )?do not distribute", 40, 0.5),
    ("proprietary", "internal use only", r"for internal use only", 40, 0.5),
    ("proprietary", "personal use only", r"for (?:your )?(?:private (?:and )?)?personal use only", 40, 0.5),
    ("proprietary", "end user license agreement", r"end user license agreement(?: eula)?", 45, 0.6),
    ("proprietary", "under license from", r"used under license from(?: \S+){1,3}", 40, 0.5),
    ("noncommercial", "non commercial", r"(?:for|strictly) non commercial (?:use|purposes?)(?: only)?", 45, 0.6),
    ("noncommercial", "noncommercial", r"(?:for|strictly) noncommercial (?:use|purposes?)(?: only)?", 45, 0.6),
    ("research-only", "research", r"for (?:academic |non commercial |noncommercial )?research (?:use|purposes?) only", 45, 0.6),
    ("no-ai-training", "may not be used", r"may not be used (?:for|to)(?: \S+){0,3} (?:train|training)(?: \S+){0,4} (?:models?|systems?|ai)", 60, 0.8),
    ("no-ai-training", "text and data mining", r"(?:reserves?|reserved)(?: \S+){0,6} text and data mining", 60, 0.8),
    ("permission-required", "written permission", r"without (?:the )?(?:express |explicit |prior )+written permission", 42, 0.6),
    ("attribution", "attribution required", r"attribution required", 35, 0.5),
    ("attribution", "permission", r"(?:reprinted|used|reproduced) (?:here )?(?:by|with) permission(?: of)?", 35, 0.5),
)


def rules() -> tuple[Rule, ...]:
    """Some hundreds of rules, in order: families times the ways of naming them, Creative Commons, and single signatures."""
    out = []
    licence = r"(?: (?:public )?licen[sc]e)?"
    for stem, shared, names, versions in _FAMILIES:
        for name in names:
            keyword = shared if shared in name else name
            lead = r"(?:(?:is |are )?(?:licensed|distributed|released|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?)"
            own = "" if name.endswith(("license", "licence")) else licence
            for version, suffix in versions.items():
                label = f"{stem}-{suffix}"
                out.append(Rule(label, keyword, rf"{lead}{name}{own} (?:v|version )?{version}", 90, 0.95))
                out.append(Rule(label, keyword, rf"{name}{own} (?:v|version ){version}", 80, 0.9))
                out.append(Rule(f"{label}-or-later", keyword, rf"{name}{own} (?:v|version )?{version} or (?:at your option )?(?:any )?later(?: version)?", 95, 0.95))
                out.append(Rule(label, "spdx license identifier", rf"spdx license identifier {name} {version}(?: only)?", 99, 1.0))
                out.append(Rule(f"{label}-or-later", "spdx license identifier", rf"spdx license identifier {name} {version} or later", 100, 1.0))
                if " " in version:
                    out.append(Rule(label, keyword, rf"{name} {version}", 70, 0.8))
            out.append(Rule(stem, keyword, rf"{lead}{name}{own}", 60, 0.8))
            if own != licence:
                out.append(Rule(stem, keyword, name, 50, 0.7))
            else:
                out.append(Rule(stem, keyword, rf"{name} licen[sc]e", 50, 0.7))
            out.append(Rule(stem, "spdx license identifier", rf"spdx license identifier {name}", 98, 1.0))
    for part, (short, long_) in _CC.items():
        out.append(Rule(f"cc-{part}", "cc by", rf"cc {short}", 60, 0.7))
        out.append(Rule(f"cc-{part}", "creative commons", rf"creative commons {long_}(?: international)?(?: public)?(?: licen[sc]e)?", 60, 0.85))
        for version in _CC_VERSIONS:
            spaced = version.replace(".", " ")
            out.append(Rule(f"cc-{part}-{version}", "cc by", rf"(?:spdx license identifier |licensed under )?cc {short} {spaced}", 90, 0.95))
            out.append(Rule(f"cc-{part}-{version}", "creative commons", rf"creative commons {long_}(?: (?:international|unported))?(?: licen[sc]e)?(?: version)? {spaced}", 90, 0.95))
            out.append(Rule(f"cc-{part}-{version}", "creativecommons org", rf"creativecommons org licenses {short} {spaced}", 95, 1.0))
    return (*out, *(Rule(*x) for x in _SINGLE))


class Scanner:
    """Rules ready to run in a task: an automaton of keywords, and each rule's expression between word bounds."""

    def __init__(self, own: tuple[Rule, ...]):
        self.rules = sorted(own, key=lambda r: -r.priority)
        self.patterns = [re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )") for r in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(k)
        for phrase, _ in BASE:
            by_keyword.setdefault(phrase, [])
        self.automaton = ahocorasick.Automaton()
        for keyword, found in by_keyword.items():
            self.automaton.add_word(keyword, (keyword, found))
        self.automaton.make_automaton()

    def words(self, text: str) -> tuple[bytes, int]:
        found = text.encode("utf-8", "surrogatepass").translate(_WORD).split()
        return b" " + b" ".join(found) + b" ", len(found)

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, Rule]], dict[str, list[int]]]:
        """Detections (first word, last word, rule), and for each base phrase its places."""
        seen = {keyword: found for _, (keyword, found) in self.automaton.iter(text.decode("latin-1"))}
        if not seen:
            return [], {}
        hits = []
        for k in sorted({k for found in seen.values() for k in found}):
            hits += [(m.start(), m.end(), self.rules[k]) for m in self.patterns[k].finditer(text)]
        places = {}
        for phrase, label in BASE:
            if phrase in seen:
                own, form, at = [], f" {phrase} ".encode(), -1
                while (at := text.find(form, at + 1)) >= 0:
                    own.append(at)
                places[label] = own
        spots = sorted({x for start, end, _ in hits for x in (start, end)} | {x + 1 for own in places.values() for x in own})
        number, before, n = {}, 0, 0
        for x in spots:  # words before each spot, counted once over the text
            n += text.count(b" ", before, x)
            number[x], before = n, x
        return resolve([(number[a] - 1, number[b] - 1, r) for a, b, r in hits]), {label: [number[x + 1] - 1 for x in own] for label, own in places.items()}


def resolve(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Hits that stay: by descending priority, then length, then place, each stays unless one that stays contains its interval,
    or overlaps it with a higher priority.

    So none that stays contains another: in order of their starts their ends rise too, and the last one that starts in time
    decides either question.
    """
    kept: list[tuple[int, int, Rule]] = []
    spans: list[tuple[int, int]] = []  # of all kept, in order
    above: list[tuple[int, int]] = []  # of those of a higher priority than the hit's
    priority = None
    for hit in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
        a, b, rule = hit
        if rule.priority != priority:
            above, priority = list(spans), rule.priority
        before = bisect.bisect_right(spans, a, key=lambda s: s[0])
        if before and spans[before - 1][1] >= b:
            continue
        before = bisect.bisect_right(above, b, key=lambda s: s[0])
        if before and above[before - 1][1] >= a:
            continue
        kept.append(hit)
        bisect.insort(spans, (a, b))
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].label))


def scan_licenses(docs: DataFrame, own: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; others are dropped): doc_id, n_words, detections (array of first word, last word, label,
    weight, after suppression), base (array of label and place, all of them).

    A-Z are lower-cased, and words are runs of 0-9, a-z and characters from U+0080; rules see them with one space between. Only
    rules whose keyword the text holds are tried. Null text is empty and has no words; repeated rows are scanned each. One pass
    over each text inside its task, nothing is shuffled.
    """
    own = own or rules()
    spec = "doc_id long, n_words long, detections array<struct<first:long,last:long,label:string,weight:double>>, base array<struct<label:string,place:long>>"
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("detections", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))),
            ("base", pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own)
        for batch in batches:
            counts, found, base = [], [], []
            for text in batch.column(1):
                plain, n = scanner.words(text.as_py() or "")
                hits, places = scanner.scan(plain)
                counts.append(n)
                found.append([{"first": a, "last": b, "label": r.label, "weight": r.weight} for a, b, r in hits])
                base.append([{"label": label, "place": x} for label, at in places.items() for x in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((counts, found, base), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, spec)
