"""License scans with DataFrame functions only.

Texts become words: A-Z lower-cased, everything that is neither a letter, a digit nor outside ASCII parts words. A keyword
prefilter passes the few texts that can hold a license at all; only those keep their words. A rule is a regular
expression over words with a keyword that each of its matches holds, a label, a priority and a confidence; it runs only where its keyword is.
Detections are intervals of words. One that lies within another of the same or a higher priority is suppressed, so that
"cc by nc sa 4 0" is not also "cc by nc". Base labels stand whatever the rules find.

Rules stand in groups by keyword. A group's literal expression decides which texts its rules are run on one by one, so
expressions that change from row to row meet few rows. Passing texts are dealt by their bytes before they are scanned.

Each step is linear in the text: a rule's places follow from a running sum over the parts between its matches, and
suppression is a running maximum of interval ends within the document. The words of passing texts are written once, under
a row number of their own, so rows that repeat are kept apart.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored, except that `key` is carried along, null or not. Ties: of detections with
the same interval and priority the rule that stands first in the list stays. A long text is one row of words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import ascii_lower
from .staging import stage

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Names of licenses by label, the more exact ones first, which wins ties: an expression over words, and the keyword that has to stand in the text. Hand-written.
NAMES = [
    ("mit", "mit(?: expat)?", "mit"), ("mit-0", "mit (?:0|zero|no attribution)", "mit"), ("x11", "(?:x11|mit x11|x consortium)", "x"), ("apache-1.1", "apache(?: software)?(?: license)? (?:version )?1 1", "apache"),
    ("apache-2", "apache(?: software)?(?: license)? (?:version )?2(?: 0)?", "apache"), ("apache", "apache(?: software(?: foundation)?)?", "apache"), ("gpl-2", "(?:gnu )?(?:gpl|general public license) ?(?:version |v)?2(?: 0)?", "g"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public license) ?(?:version |v)?3(?: 0)?", "g"), ("gpl", "(?:gnu gpl|gnu general public license|gpl)", "g"), ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?2 1", "l"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?3(?: 0)?", "l"), ("lgpl", "(?:gnu lesser general public license|gnu library general public license|lgpl)", "l"), ("agpl-3", "(?:gnu )?(?:agpl|affero general public license) ?(?:version |v)?3(?: 0)?", "a"),
    ("agpl", "(?:gnu affero general public license|agpl)", "a"), ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)", "bsd"), ("bsd-2-clause", "freebsd", "freebsd"), ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd"), ("0bsd", "0bsd", "0bsd"), ("0bsd", "(?:zero clause bsd|bsd zero clause)", "bsd"), ("bsd", "bsd", "bsd"), ("mpl-1.1", "(?:mozilla public license|mpl) ?(?:version |v)?1 1", "m"),
    ("mpl-2", "(?:mozilla public license|mpl) ?(?:version |v)?2(?: 0)?", "m"), ("mpl", "(?:mozilla public license|mpl)", "m"), ("epl-1", "(?:eclipse public license|epl) ?(?:version |v)?1(?: 0)?", "e"), ("epl-2", "(?:eclipse public license|epl) ?(?:version |v)?2(?: 0)?", "e"),
    ("cddl", "common development and distribution license", "common"), ("cddl", "cddl", "cddl"), ("cpl", "common public license", "common"), ("isc", "(?:isc|internet systems consortium)", "i"), ("zlib", "zlib(?: libpng)?", "zlib"), ("boost", "boost software", "boost"), ("boost", "bsl 1 0", "bsl"),
    ("artistic-2", "artistic(?: license)? (?:version )?2(?: 0)?", "artistic"), ("artistic", "(?:perl )?artistic", "artistic"), ("unlicense", "(?:the )?unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to)", "w"), ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "c"),
    ("cc-by", "cc by(?: [1-4] [05])?", "cc"), ("cc-by", "creative commons attribution(?: [1-4] [05])?", "creative"), ("cc-by-sa", "cc by sa(?: [1-4] [05])?", "cc"), ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?", "creative"), ("cc-by-nd", "cc by nd(?: [1-4] [05])?", "cc"), ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "creative"),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?", "cc"), ("cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?", "creative"), ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?", "cc"), ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "creative"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?", "cc"), ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?", "creative"), ("odbl", "(?:open database license|odbl)", "o"), ("odc-by", "(?:open data commons attribution|odc by)", "o"), ("ofl", "(?:sil )?open font license", "open"),
    ("python", "(?:python software foundation|psf)(?: license)?(?: version 2)?", "p"), ("php", "php license", "php"), ("ruby", "ruby license", "ruby"), ("openssl", "openssl", "openssl"), ("eupl", "(?:european union public license|eupl)", "eu"), ("ms-pl", "(?:microsoft public license|ms pl)", "m"),
    ("gfdl", "(?:gnu free documentation license|gfdl)", "g"), ("postgresql", "postgresql license", "postgresql"), ("bsl", "business source license", "business"), ("sspl", "(?:server side public license|sspl)", "s"), ("elastic", "elastic license", "elastic"), ("cecill", "cecill", "cecill"),
]
#: Ways in which a text names a license: expression around the name, priority, confidence, and words that every match of it holds. Hand-written.
_VERBS = "(?:licensed|released|distributed|available|provided|published|covered|offered) (?:to you )?under"
_TERMS = "(?:subject to|governed by|pursuant to|according to)"
WAYS = [
    ("spdx license identifier {name}", 3, 1.0, "spdx license identifier"),
    (_VERBS + " (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: (?:public )?licen[sc]e)?(?: version \\d+(?: \\d+)?)?", 2, 0.95, _VERBS),
    ("under (?:the )?(?:terms of )?(?:the )?{name} licen[sc]e", 2, 0.9, "licen[sc]e"),
    (_TERMS + " (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?", 2, 0.85, _TERMS),
    ("licen[sc]e (?:is |type |name )?(?:the )?{name}", 2, 0.8, "licen[sc]e"),
    ("{name} (?:public )?licen[sc]e(?: (?:version|v) ?\\d+(?: \\d+)?)?", 1, 0.7, "licen[sc]e"),
]
#: Signatures of license texts and file headers that need not name the license: label, expression, keyword, and words that every match holds. Hand-written.
_GNU = "it under the terms of the gnu {} public license as published by the free software foundation"
BODIES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission", "permission is hereby granted"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "permission", "permission to use copy modify"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission", "permission to use copy modify"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission", "permission is hereby granted"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software", "permission", "permission is hereby granted"),
    ("x11", "except as contained in this notice the name of (?:the )?(?:x consortium|[^ ]+(?: [^ ]+){0,5}) shall not be used in advertising or otherwise to promote the sale", "except", "except as contained in this notice"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution", "redistribution and use in source"),
    ("bsd-3-clause", "neither the names? of [^ ]+(?: [^ ]+){0,12} (?:nor the names of (?:its|their|the) contributors )?may be used to endorse or promote products derived from this software", "neither", "neither the names? of"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", "advertising materials mentioning"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission", "permission is granted to anyone"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", "unencumbered software"),
    ("wtfpl", "(?:0 )?you just do what the fuck you want to", "fuck", "just do what the fuck"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0", "compliance", "licenses"),
    ("apache-2", "apache license version 2 0 january 2004", "apache", "apache license"),
    ("gpl", _GNU.format("general"), "gnu", "gnu general public license"), ("lgpl", _GNU.format("(?:lesser|library) general"), "gnu", "general public license"), ("agpl", _GNU.format("affero general"), "gnu", "gnu affero"),
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu", "gnu general public license"), ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu", "gnu general public license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "gnu", "gnu lesser"), ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", "gnu", "gnu lesser"), ("agpl-3", "gnu affero general public license version 3 19 november 2007", "gnu", "gnu affero"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", "mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla", "mozilla public license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0", "eclipse", "eclipse public license"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0", "eclipse", "eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common", "common development and distribution"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu", "gnu free documentation"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent", "the intent of this document"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "deed", "with this deed"),
]
#: Signatures of notices, addresses, SPDX expressions, choices of licenses and sentences of license texts: label, expression and, where the
#: longest run of plain words would not do, words that every match holds. Hand-written.
NOTICES = """
mit | opensource org licenses? mit(?: license)?
mit | mit license(?: mit)? copyright (?:c )?(?:19|20)\\d\\d
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | choosealicense com licenses mit
mit | see (?:the )?license file for (?:the )?(?:full )?mit license text
apache-2 | (?:www )?apache org licenses license 2 0(?: (?:txt|html))?
apache-2 | opensource org licenses apache 2 0
apache-2 | asl 2 0
apache-2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | (?:www )?apache org licenses license 1 1
apache-1.1 | this product includes software developed by the apache (?:software foundation|group)
llvm-exception | apache(?: license)?(?: version)? 2 0 with llvm exceptions? | with llvm
mit-or-apache-2 | mit or apache(?: license)?(?: version)? 2 0 | mit or apache
mit-or-apache-2 | apache(?: license)?(?: version)? 2 0 or (?:the )?mit | apache
mit-or-apache-2 | licensed under either of apache license version 2 0
mit-or-gpl | dual mit gpl
mit-or-gpl | dual licensed under (?:the )?mit (?:license )?(?:and|or) (?:the )?gpl
bsd-or-gpl | dual bsd gpl
mpl-1.1-or-gpl-or-lgpl | version mpl 1 1 gpl 2 0 lgpl 2 1
gpl-2 | gnu org licenses (?:old licenses )?(?:gpl 2 0|gplv2)
gpl-3 | gnu org licenses (?:gpl 3 0|gplv3)
gpl | gnu org (?:licenses|copyleft) gpl
gpl | the licenses for most software are designed to take away your freedom to share and change it
gpl | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | see the gnu general public license for more details
gpl | you should have received a copy of the gnu general public license along with
gpl-2-only | gpl 2 0 only | gpl 2 0
gpl-3-only | gpl 3 0 only | gpl 3 0
gpl-2-or-later | gpl 2 0 or later | gpl 2 0
gpl-3-or-later | gpl 3 0 or later | gpl 3 0
gpl-2-or-later | (?:gpl v2|gplv2|gpl version 2) or (?:any )?(?:later|newer)(?: version)? | gpl
gpl-3-or-later | (?:gpl v3|gplv3|gpl version 3) or (?:any )?(?:later|newer)(?: version)? | gpl
gpl-2-or-later | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3-or-later | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2-only | gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-2-classpath | gpl 2 0(?: only| or later)? with classpath exception 2 0 | with classpath exception
gpl-2-classpath | gpl version 2 with the classpath exception
gpl-2-linux-note | gpl 2 0(?: only| or later)? with linux syscall note | with linux syscall note
gpl-3-gcc-exception | gpl 3 0(?: only| or later)? with gcc exception 3 1 | with gcc exception
gpl-3-gcc-exception | gcc runtime library exception version 3 1
lgpl-2.1 | gnu org licenses (?:old licenses )?(?:lgpl 2 1|lgplv2 1)
lgpl-3 | gnu org licenses (?:lgpl 3 0|lgplv3)
lgpl | gnu org (?:licenses|copyleft) lesser
lgpl-2.1-only | lgpl 2 1 only | lgpl 2 1
lgpl-3-only | lgpl 3 0 only | lgpl 3 0
lgpl-2.1-or-later | lgpl 2 1 or later | lgpl 2 1
lgpl-3-or-later | lgpl 3 0 or later | lgpl 3 0
lgpl-2.1-or-later | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3-or-later | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-3 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl | see the gnu lesser general public license for more details
agpl-3 | gnu org licenses (?:agpl 3 0|agplv3)
agpl-3-only | agpl 3 0 only | agpl 3 0
agpl-3-or-later | agpl 3 0 or later | agpl 3 0
agpl-3-or-later | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-3 | remote network interaction use with the gnu general public license
gnu-license-text | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gfdl | gnu org (?:licenses|copyleft) fdl
gfdl | with no invariant sections no front cover texts and no back cover texts
bsd-2-clause | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org licenses bsd 3 clause
bsd-3-clause | use of this source code is governed by a bsd style license that can be found in the license file
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd | this software is provided by the (?:copyright holders|regents|author) and contributors as is and any express or implied warranties
mpl-2 | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla org mpl mpl 1 1
mpl | mozilla org mpl
mpl-2 | opensource org licenses mpl 2 0
mpl-2 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2-no-copyleft-exception | this source code form is incompatible with secondary licenses
epl-1 | eclipse org legal epl v10
epl-2 | eclipse org legal epl (?:v20|2 0)
epl | the accompanying program is provided under the terms of this eclipse public license
cddl | opensource org licenses cddl
cddl | you can find a copy of the cddl at
cpl | opensource org licenses cpl1 0
ipl | ibm public license(?: version)? 1 0
isc | opensource org licenses isc(?: license)?
isc | the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software
zlib | opensource org licenses zlib
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | the png reference library is supplied as is
ijg | this software is based in part on the work of the independent jpeg group
ftl | portions of this software are copyright (?:c )?(?:\\d{4} )?the freetype project
boost | boost org license 1 0
boost | opensource org licenses bsl 1 0
artistic-2 | opensource org licenses artistic 2 0
artistic-2 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | under the same terms as perl itself
ruby | you may make and give away verbatim copies of the source form of the software without restriction
unlicense | unlicense org
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | wtfpl net
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | the software shall be used for good not evil
cc-by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc-sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0 | creativecommons org publicdomain zero 1 0
cc0 | statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright
public-domain | creativecommons org publicdomain mark 1 0
public-domain | (?:is|are|been|hereby) (?:placed )?in the public domain
public-domain | dedicates? (?:any and all copyright interest in )?(?:this|the) (?:work|software) to the public domain
cc | you accept and agree to be bound by the terms and conditions of this creative commons
odbl | opendatacommons org licenses odbl
odbl | this database is made available under the open database license
odc-by | opendatacommons org licenses by
pddl | opendatacommons org licenses pddl
pddl | public domain dedication and license
ogl-uk | open government licen[sc]e(?: v[1-3]| version [1-3])?
etalab | licence ouverte(?: open licence)? etalab
dl-de-by | data licen[sc]e germany attribution
cdla-permissive | community data license agreement permissive
ofl | scripts sil org ofl
ofl | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
ubuntu-font | ubuntu font licen[sc]e
bitstream-vera | bitstream vera is a trademark of bitstream
gust-font | gust font license
python | psf is making python available to licensee on an as is basis
php | this product includes php software freely available from
openssl | this product includes software developed by the openssl project
ssleay | this product includes cryptographic software written by eric young
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ncsa | university of illinois (?:ncsa )?open source license
ncsa | opensource org licenses ncsa
w3c | w3c software (?:and document )?notice and license
unicode | unicode inc license agreement data files and software
vim | vim is charityware
lppl | latex project public license
lppl | lppl version 1 \\d
osl-3 | open software license(?: version| v)? 3 0
afl-3 | academic free license(?: version| v)? 3 0
apsl-2 | apple public source license(?: version)? 2 0
npl | netscape public license
spl | sun public license
qpl | q public license(?: version)? 1 0
zpl | zope public license
ecl-2 | educational community license(?: version)? 2 0
upl | universal permissive license(?: v| version)? 1 0
ms-rl | microsoft reciprocal license
ms-pl | opensource org licenses ms pl
cpal | common public attribution license
eupl | joinup ec europa eu (?:software page|collection) eupl
mulan-2 | mulan (?:psl v2|pslv2|permissive software license v2)
blueoak | blue oak model license
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
condor | condor public license
hippocratic | hippocratic license
polyform-noncommercial | polyform noncommercial license
polyform-small-business | polyform small business license
commons-clause | the license does not grant to you the right to sell the software
commons-clause | commons clause license condition
bsl | business source license 1 1
bsl | change license means
sspl | server side public license version 1
sspl | offering the program as a service
elastic | you may not provide the software to third parties as a hosted or managed service
elastic | elastic co licensing elastic license
free-art | free art license
free-art | licence art libre
openrail | creativeml open rail m
openrail | open rail license
bigscience-rail | bigscience rail license
llama | llama \\d community license agreement
gemma | gemma terms of use
""".replace("\\\\", "\\")


def held_words(expression: str) -> str:
    """The longest run of plain words, four at most, that stands in every match of an expression without nested choices."""
    flat = re.sub(r" ?\(\?:[^()]*\)\?? ?", " | ", expression)
    best = max((" ".join(run) for part in flat.split("|") for run in _plain_runs(part.split())), key=len).split()
    at = best.index(max(best, key=len))
    first = min(max(0, at - 1), max(0, len(best) - 4))
    return " ".join(best[first : first + 4])


def _notices() -> list[tuple[str, str, str]]:
    """label, expression, held words of each notice."""
    rows = [[x.strip() for x in line.split(" | ")] for line in NOTICES.strip().splitlines()]
    return [(label, x, own[0] if own else held_words(x)) for label, x, *own in rows]


def _plain_runs(words: list[str]) -> list[list[str]]:
    runs: list[list[str]] = [[]]
    for word in words:
        if re.fullmatch("[a-z0-9]+", word):
            runs[-1].append(word)
        else:
            runs.append([])
    return runs


#: Words that bare Creative Commons marks hold.
_BARE = ["cc by", "creative commons attribution"]
#: What words of a text in lower case are made of, and what stands between two of them.
_IN_WORD = "0-9a-z\\u0080-\\x{10FFFF}"
GAP = f"[^{_IN_WORD}]+"
#: What a text of any license has to hold, one of them, in words.
HELD = list(dict.fromkeys([w[3] for w in WAYS] + _BARE + [b[3] for b in BODIES] + [x for _, _, x in _notices()]))


def _prefilter(held: list[str]) -> str:
    """One expression for all that is held, from the start of a word on; sorted by first letter, so that most places are left after one look."""
    by_letter: dict[str, list[str]] = {}
    for phrase in held:
        choice = re.match(r"\(\?:([^()]*)\)(.*)", phrase)
        for one in [x + choice[2] for x in choice[1].split("|")] if choice else [phrase]:
            by_letter.setdefault(one[0], []).append(one[1:].replace(" ", GAP))
    return f"(?<![{_IN_WORD}])(?:" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items())) + ")"


#: What a text has to hold to be searched at all, in lower case: what the rules hold, with anything that parts words between them.
PREFILTER = _prefilter(HELD)
#: Bytes of passing words that one task scans, about.
TASK_BYTES = 1 << 20
WORD = "[0-9A-Za-z\\u0080-\\x{10FFFF}]+"


def rules() -> list[tuple]:
    """(number, label, keyword, expression, priority, confidence): ways of names, bare Creative Commons marks, license bodies, and notices."""
    rows = [(label, keyword, way.format(name=name), priority, score) for label, name, keyword in NAMES for way, priority, score, _ in WAYS]
    rows += [(label, keyword, name, 1, 0.6) for label, name, keyword in NAMES if label.startswith("cc-by")]
    rows += [(label, keyword, body, 3, 0.95) for label, body, keyword, _ in BODIES]
    rows += [(label, max(reversed(held.split()), key=len), x, 3, 0.9) for label, x, held in _notices()]
    return [(number, *row) for number, row in enumerate(rows)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last start of a phrase in words that each have a space before and the last one after."""
    wide, wanted, tight = F.replace(words, F.lit(" "), F.lit("  ")), f" {phrase.replace(' ', '  ')} ", f" {phrase} "
    places = ((F.length(wide) - F.length(F.replace(wide, F.lit(wanted), F.lit("")))) / len(wanted)).cast("long")
    first = F.locate(tight, words)
    last = F.length(words) - F.locate(tight[::-1], F.reverse(words)) + 1 - len(tight)
    held = first > 0
    return places, F.when(held, _spaces(F.substring(words, F.lit(1), first - 1))), F.when(held, _spaces(F.substring(words, F.lit(1), last)))


def scan_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_words, and the words of the texts that pass the prefilter."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole.alias("text"))
    passing = F.lower("text").rlike(PREFILTER)
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    return rows.select("row", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(passing, words).alias("words"))


def detections(words: DataFrame) -> DataFrame:
    """row, label, score of the detections that no other suppresses. words: row and words."""
    spark = words.sparkSession
    table = spark.createDataFrame(rules(), "rule int, label string, keyword string, expression string, priority int, score double")
    groups: dict[str, list[str]] = {}
    for _, _, keyword, expression, _, _ in rules():
        groups.setdefault(keyword, []).append(expression)
    held = [F.when(F.contains("words", F.lit(" " + k)) & F.col("words").rlike(f"(?<= )(?:{'|'.join(own)})(?= )"), F.lit(k)) for k, own in sorted(groups.items())]
    asked = words.select("row", "words", F.explode(F.array_compact(F.array(*held))).alias("keyword")).join(F.broadcast(table), "keyword")  # the rules are a fixed table

    around = F.concat(F.lit("(?<= )(?:"), "expression", F.lit(")(?= )"))
    met = asked.select("row", "rule", "label", "priority", "score", "words", around.alias("wanted")).where(F.expr("rlike(words, wanted)"))
    parts = met.select("row", "rule", "label", "priority", "score", F.posexplode(F.arrays_zip(F.expr("split(words, wanted)").alias("gap"), F.expr("regexp_extract_all(words, wanted, 0)").alias("match"))).alias("place", "part"))
    gap, match = F.length(F.col("part").getField("gap")), F.length(F.col("part").getField("match"))
    so_far = Window.partitionBy("row", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("end", F.sum(gap + F.coalesce(match, F.lit(0))).over(so_far)).where(match.isNotNull()).withColumn("start", F.col("end") - match)

    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    for level in (1, 2, 3):
        placed = placed.withColumn(f"end{level}", F.max(F.when(F.col("priority") >= level, F.col("end"))).over(order))
    around_it = F.element_at(F.array("end1", "end2", "end3"), F.col("priority"))
    return placed.where(around_it.isNull() | (around_it < F.col("end"))).select("row", "label", "score")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    found = stage(scan_words(docs, key, text), "license-words")
    passing = found.where("words IS NOT NULL").select("row", "words")
    size = passing.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    passing = passing.repartition(int(size // TASK_BYTES) + 1, "row")
    own = detections(passing).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    own = stage(own, "licenses")

    facts = [(_base(F.col("words"), phrase), label) for phrase, label in BASE.items()]
    total = sum((F.coalesce(places, F.lit(0)) for (places, _, _), _ in facts), F.lit(0))
    named = F.array_sort(F.array_compact(F.array(*[F.when(places > 0, F.lit(label)) for (places, _, _), label in facts])))
    base = found.select("row", "key", "n_words", total.cast("long").alias("n_base"), F.least(*[f for (_, f, _), _ in facts]).cast("long").alias("first_word"), F.greatest(*[x for (_, _, x), _ in facts]).cast("long").alias("last_word"), named.alias("base"))
    joined = base.join(own, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return joined.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
