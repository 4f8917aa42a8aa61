"""License scans by ordered signature rules.

Each text is reduced to its words (ASCII letters and digits, lower-cased, and all non-ASCII characters) joined by
single spaces. Rules are regular expressions over that form, hand-written below: titles and tags, addresses, notices.
An Aho-Corasick automaton finds the rules' keywords first, and only rules whose keyword occurs are tried, around it.
The detections are ordered by priority, then length, then rule and place; one whose interval lies within that of a
detection before it is suppressed. Base phrases are found by themselves and never suppressed. The time of all this is
in proportion to the text, give or take the logarithm of its number of detections.

Defined results: null and empty texts have no words and no detections, score 0; ties between equal intervals go to
the rule listed first; repeated rows repeat; an empty table gives no rows; extra columns are ignored. Whole texts
are scanned; memory is that of one batch or the longest text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import arrow_map, arrow_schema, fields

#: Lower-cases A-Z and turns `[\x00-\x2F\x3A-\x60\x7B-\x7F]` to spaces; the bytes of other characters stay.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label; SPDX identifiers as words (a regex); titles as words (a regex). One line a license.
FAMILIES = r"""
0bsd | 0bsd | (?:zero clause|0 clause) bsd(?: license)?
afl-3.0 | afl 3 0 | academic free license(?: v)?(?: version)? 3(?: 0)?
agpl-3.0 | agpl 3 0(?: only| or later)? | gnu affero general public license(?: as published by the free software foundation)?(?: v| version)? ?3(?: 0)?
agpl | agpl | gnu affero general public license
apache-1.1 | apache 1 1 | apache (?:software )?license(?: version| v)? 1 1
apache-2.0 | apache 2(?: 0)? | apache (?:software )?license(?: version| v)? ?2(?: 0)?
apsl-2.0 | apsl 2 0 | apple public source license(?: version)?(?: 2(?: 0)?)?
artistic-2.0 | artistic 2 0 | (?:the )?artistic license(?: version)? 2(?: 0)?
artistic | artistic 1 0 | (?:perl )?artistic license
beerware | beerware | the beer ware license
bsd-2-clause | bsd 2 clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) license
bsd-3-clause | bsd 3 clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) license
bsd-4-clause | bsd 4 clause | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) license
bsd | bsd | (?:bsd style|bsd) licen[cs]e
bsl-1.0 | bsl 1 0 | boost software license(?: version)?(?: 1(?: 0)?)?
busl-1.1 | busl 1 1 | business source license(?: version)?(?: 1 1)?
cc0-1.0 | cc0 1 0 | (?:cc0|creative commons zero)(?: v)?(?: ?1 0)?(?: universal)?
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:creative commons )?attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-4.0 | cc by nc 4 0 | (?:creative commons )?attribution non ?commercial 4 0(?: international)?
cc-by-nd-4.0 | cc by nd 4 0 | (?:creative commons )?attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-sa-4.0 | cc by sa 4 0 | (?:creative commons )?attribution share ?alike 4 0(?: international)?
cc-by-4.0 | cc by 4 0 | creative commons attribution(?: license)? 4 0(?: international)?
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 3 0(?: unported)?
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | (?:creative commons )?attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-3.0 | cc by nc 3 0 | (?:creative commons )?attribution non ?commercial 3 0(?: unported)?
cc-by-sa-3.0 | cc by sa 3 0 | (?:creative commons )?attribution share ?alike 3 0(?: unported)?
cc-by-3.0 | cc by 3 0 | creative commons attribution(?: license)? 3 0(?: unported)?
cc-by-sa-2.0 | cc by sa 2 [05] | (?:creative commons )?attribution share ?alike 2 [05](?: generic)?
cc-by-2.0 | cc by 2 [05] | creative commons attribution(?: license)? 2 [05](?: generic)?
cc-by-nc | cc by nc | creative commons attribution non ?commercial
cc-by-sa | cc by sa | creative commons attribution share ?alike
cddl-1.0 | cddl 1 [01] | common development and distribution license(?: version)?(?: 1 [01])?
cecill | cecill(?: [abc])?(?: 1 [01]| 2 [01])? | cecill (?:free software )?licen[cs]e
cpal-1.0 | cpal 1 0 | common public attribution license(?: version)?(?: 1 0)?
cpl-1.0 | cpl 1 0 | common public license(?: version)?(?: 1 0)?
ecl-2.0 | ecl 2 0 | educational community license(?: version)?(?: 2 0)?
elastic-2.0 | elastic 2 0 | elastic license(?: version)?(?: 2 0)?
epl-1.0 | epl 1 0 | eclipse public license(?: version| v)? 1(?: 0)?
epl-2.0 | epl 2 0 | eclipse public license(?: version| v)? 2(?: 0)?
epl | epl | eclipse public license
eupl | eupl 1 [012] | european union public licen[cs]e(?: version| v)?(?: 1 [012])?
fdl-1.3 | gfdl 1 [123](?: only| or later)? | gnu free documentation license(?: version)? 1 [123]
fdl | gfdl | gnu free documentation license
gpl-1.0 | gpl 1 0(?: only| or later)? | gnu general public license(?: version| v)? ?1(?: 0)?
gpl-2.0 | gpl 2 0(?: only| or later)? | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?
gpl-3.0 | gpl 3 0(?: only| or later)? | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
hpnd | hpnd | historical permission notice and disclaimer
icu | icu | (?:the )?icu license
ijg | ijg | independent jpeg group
ipl-1.0 | ipl 1 0 | ibm public license(?: version)?(?: 1 0)?
isc | isc | (?:the )?isc licen[cs]e
lgpl-2.0 | lgpl 2 0(?: only| or later)? | gnu (?:library|lesser) general public license(?: version| v)? ?2(?: 0)?
lgpl-2.1 | lgpl 2 1(?: only| or later)? | gnu lesser general public license(?: version| v)? ?2 1
lgpl-3.0 | lgpl 3 0(?: only| or later)? | gnu lesser general public license(?: version| v)? ?3(?: 0)?
lgpl | lgpl | gnu (?:lesser|library) general public license
libpng | libpng(?: 2 0)? | (?:the )?libpng license
llama | llama ?[234](?: [123])? | llama ?[234](?: [123])? community license(?: agreement)?
lppl | lppl 1 (?:[012]|3[ac]) | latex project public license(?: version)?(?: 1 (?:[012]|3[ac]))?
mit | mit | (?:the )?(?:mit|expat|x11|mit style) licen[cs]e
mit-0 | mit 0 | mit no attribution(?: license)?
mpl-1.1 | mpl 1 [01] | mozilla public license(?: version| v)? 1 [01]
mpl-2.0 | mpl 2 0(?: no copyleft exception)? | mozilla public license(?: version| v)? ?2(?: 0)?
mpl | mpl | mozilla public license
ms-pl | ms pl | microsoft public license
ms-rl | ms rl | microsoft reciprocal license
mulan-psl-2.0 | mulanpsl [12] 0 | mulan (?:psl|permissive software license)(?: version| v)?(?: ?[12])?
ncsa | ncsa | (?:university of illinois ncsa|ncsa) open source license
npl | npl 1 [01] | netscape public license(?: version)?(?: 1 [01])?
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database license(?: v)?(?: ?1 0)?
odc-by-1.0 | odc by 1 0 | open data commons attribution license(?: v)?(?: ?1 0)?
ofl-1.1 | ofl 1 [01] | (?:sil )?open font license(?: version)?(?: 1 [01])?
openrail | openrail(?: m)? | (?:creativeml )?open ?rail(?: \+\+)?(?: m)? license
openssl | openssl | openssl license
osl-3.0 | osl 3 0 | open software license(?: version| v)?(?: 3 0)?
pddl-1.0 | pddl 1 0 | public domain dedication and licen[cs]e
php-3.01 | php 3 0(?:1)? | php license(?: version)?(?: 3 0(?:1)?)?
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | psf 2 0 | python software foundation license(?: version)?(?: 2)?
python-2.0 | python 2 0 | python license(?: version)?(?: 2 0)?
qpl-1.0 | qpl 1 0 | q public license(?: version)?(?: 1 0)?
ruby | ruby | ruby license
sspl-1.0 | sspl 1 0 | server side public license(?: version| v)?(?: ?1)?
tcl | tcl | tcl tk license
ubuntu-font | ubuntu font 1 0 | ubuntu font licen[cs]e(?: version)?(?: 1 0)?
unicode | unicode dfs 201[56] | unicode (?:inc )?license agreement
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | upl 1 0 | universal permissive license(?: version| v)?(?: 1 0)?
vim | vim | vim license
w3c | w3c | w3c software (?:notice and|and document) license
wtfpl | wtfpl | do what the fuck you want to public license
x11 | x11 | x11 license
zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
zpl-2.1 | zpl 2 [01] | zope public license(?: version| v)?(?: 2 [01])?
"""

# Label; an address as words (a regex).
ADDRESSES = r"""
apache-2.0 | apache org licenses license 2 0
apache | apache org licenses
bsd-2-clause | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org licenses bsd 3 clause
cc0-1.0 | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | creativecommons org licenses by nc nd
cc-by-nc-sa | creativecommons org licenses by nc sa
cc-by-nc | creativecommons org licenses by nc
cc-by-nd | creativecommons org licenses by nd
cc-by-sa | creativecommons org licenses by sa
cc-by | creativecommons org licenses by
epl-2.0 | eclipse org legal epl 2 0
agpl | gnu org licenses agpl(?: 3 0)?
gpl-2.0 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org licenses gpl 3 0
gpl | gnu org licenses gpl
lgpl | gnu org licenses lgpl
fdl | gnu org licenses fdl
isc | opensource org licenses isc
mit | opensource org licenses mit(?: license)?
mpl-2.0 | mozilla org mpl 2 0
mpl | mozilla org mpl
ofl-1.1 | scripts sil org ofl
unlicense | unlicense org
wtfpl | wtfpl net
bsl-1.0 | boost org license 1 0
zlib | zlib net zlib license
apache-1.1 | apache org licenses license 1 1
cc-by-4.0 | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
cc-by-3.0 | creativecommons org licenses by 3 0
cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
public-domain | creativecommons org publicdomain mark 1 0
0bsd | opensource org licenses? 0bsd
agpl-3.0 | opensource org licenses? agpl(?: v3| 3 0)
apache-2.0 | opensource org licenses? apache 2 0
artistic-2.0 | opensource org licenses? artistic(?: license)? 2 0
bsl-1.0 | opensource org licenses? bsl 1 0
cddl-1.0 | opensource org licenses? cddl 1(?: 0)?
epl-2.0 | opensource org licenses? epl 2 0
gpl-2.0 | opensource org licenses? gpl 2 0
gpl-3.0 | opensource org licenses? gpl 3 0
lgpl-2.1 | opensource org licenses? lgpl 2 1
lgpl-3.0 | opensource org licenses? lgpl 3 0
mpl-2.0 | opensource org licenses? mpl 2 0
ncsa | opensource org licenses? (?:uoi )?ncsa
ofl-1.1 | opensource org licenses? ofl 1 1
postgresql | opensource org licenses? postgresql
unlicense | opensource org licenses? unlicense
zlib | opensource org licenses? zlib(?: license)?
apache-2.0 | choosealicense com licenses apache 2 0
gpl-3.0 | choosealicense com licenses gpl 3 0
mit | choosealicense com licenses mit
mpl-2.0 | choosealicense com licenses mpl 2 0
odbl-1.0 | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons org licenses by
pddl-1.0 | opendatacommons org licenses pddl
cecill | cecill info licences
elastic-2.0 | elastic co licensing elastic license
llama | ai meta com (?:resources models and libraries )?llama(?: downloads| license)
mulan-psl-2.0 | license coscl org cn mulanpsl2?
openssl | openssl org source license
php-3.01 | php net license 3 01
psf-2.0 | docs python org (?:[23] )?license
sspl-1.0 | mongodb com licensing server side public license
vim | vimhelp org uganda
w3c | w3 org consortium legal(?: 2002| 2015)? copyright software
"""

# Label; a keyword; a sentence of the notice as words (a regex).
NOTICES = r"""
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
zlib | as is without | this software is provided as is without any express or implied warranty in no event will the authors be held liable
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
gpl | redistribute it and or modify | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | lesser general public | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
public-domain | public domain | (?:released into|placed in|dedicated to|in) the public domain
all-rights-reserved | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
non-commercial | commercial use | (?:non commercial use only|not for commercial use|no commercial use)
wtfpl | what the fuck | you just do what the fuck you want to
beerware | beer in return | you can buy me a beer in return
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merge publish distribute sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | action of contract tort | liable for any claim damages or other liability whether in an action of contract tort or otherwise
bsd | retain the above copyright | redistributions of source code must retain the above copyright notice
bsd | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | this software is provided by the | this software is provided by the (?:regents and contributors|copyright holders) as is
bsd | regents of the university | the regents of the university of california
bsd-3-clause | without specific prior written | to endorse or promote products derived from this software without specific prior written permission
isc | disclaims all warranties with regard | the author disclaims all warranties with regard to this software
zlib | plainly marked as such | altered source versions must be plainly marked as such
zlib | must not be misrepresented | the origin of this software must not be misrepresented
zlib | removed or altered from any | this notice may not be removed or altered from any source distribution
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | contributor license agreements | licensed to the (?:apache software foundation asf|asf) under one or more contributor license agreements
apache-1.1 | includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl | hope that it will be useful | this program is distributed in the hope that it will be useful but without any warranty
lgpl | hope that it will be useful | this library is distributed in the hope that it will be useful but without any warranty
gpl | received a copy of the gnu general | you should have received a copy of the gnu general public license
lgpl | received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
gpl | verbatim copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document
gpl-2.0 | version 2 of the license | (?:general public license as published by the free software foundation )(?:either )?version 2 of the license
gpl-3.0 | version 3 of the license | (?:general public license as published by the free software foundation )(?:either )?version 3 of the license
lgpl-2.1 | version 2 1 of the license | (?:general public license as published by the free software foundation )(?:either )?version 2 1 of the license
agpl | interacting with it remotely | all users interacting with it remotely through a computer network
fdl | no invariant sections | with no invariant sections(?: with)? no front cover texts
fdl | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file
mpl-2.0 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | terms of the common development | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | terms of this common public | the accompanying program is provided under the terms of this common public license
cc0-1.0 | waived all copyright | has waived all copyright and related or neighbou?ring rights
cc-by | creative commons attribution | this work is licensed under (?:a|the) creative commons attribution
cc-by-sa | creative commons attribution | this work is licensed under (?:a|the) creative commons attribution share ?alike
cc-by | wikipedia | text from wikipedia .{0,40}creative commons
unlicense | free to copy modify publish | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | jurisdictions that recognize | in jurisdictions that recognize copyright laws the author or authors of this software dedicate
wtfpl | verbatim or modified copies | everyone is permitted to copy and distribute verbatim or modified copies of this license document
bsl-1.0 | person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
artistic | same terms as perl | (?:redistribute it and or modify it )?under the same terms as perl(?: itself)?
ofl-1.1 | this font software is licensed | this font software is licensed under the sil open font license
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
python-2.0 | psf hereby grants licensee | psf hereby grants licensee a nonexclusive royalty free world wide license
postgresql | in no event shall the university | in no event shall the university of california be liable to any party
hpnd | and its documentation for any purpose | permission to use copy modify and distribute this software and its documentation for any purpose
x11 | except as contained in this notice | except as contained in this notice the names? of .{1,80} shall not be used in advertising
openssl | developed by the openssl project | this product includes software developed by the openssl project
openssl | written by eric young | this product includes (?:cryptographic )?software written by eric young
php-3.01 | includes php software | this product includes php software freely available from
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
ms-pl | bear the risk of using it | the software is licensed as is you bear the risk of using it
upl-1.0 | the condition set forth below | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | non production use of the licensed | make non production use of the licensed work
sspl-1.0 | to third parties as a service | make the functionality of the program or a modified version available to third parties as a service
eupl | under the eupl | licensed under the eupl
cecill | governed by the cecill | this software is governed by the cecill(?: [abc])? license
lppl | latex project public | may be distributed and or modified under the conditions of the latex project public license
vim | charityware | vim is charityware
ecl-2.0 | educational community license | licensed under the educational community license
npl | netscape public license | the contents of this file are subject to the netscape public license
llama | llama materials | (?:the )?llama materials
openrail | use based restrictions | use based restrictions as (?:referenced|set forth) in
odbl-1.0 | open database license | (?:database )?is made available under the open database license
odbl-1.0 | openstreetmap contributors | (?:c |copyright )?openstreetmap contributors
public-domain | no known copyright | no known copyright restrictions
public-domain | united states government | (?:work of the|works? of) united states government
public-domain | not subject to copyright | not subject to copyright(?: protection)?
public-domain | copyright has expired | (?:its|the|whose) copyright has expired
all-rights-reserved | may be reproduced | no part of this (?:publication|book|work|document) may be reproduced
all-rights-reserved | without the prior written | without the prior written (?:permission|consent) of the (?:publisher|author|copyright (?:owner|holder))
all-rights-reserved | may not be published broadcast | this material may not be published broadcast rewritten or redistributed
proprietary | unauthorized copying of this | unauthorized copying of this (?:file|software|program)
proprietary | confidential and proprietary | confidential and proprietary(?: information)?
proprietary | trade secret | (?:contains|constitutes|proprietary) trade secrets?
proprietary | property of | licensed materials? property of
proprietary | do not distribute | (?:internal use only )?do not distribute
non-commercial | for non commercial | for non commercial (?:purposes?|research)(?: only)?
non-commercial | personal use only | for personal use only
non-commercial | purposes only | for (?:academic|research|educational) purposes only
no-derivatives | no derivative works | no derivative works(?: permitted)?
evaluation | evaluation purposes | for evaluation purposes only
end-user-license | end user license agreement | end user license agreement(?: eula)?
"""

#: Priorities: a smaller number wins. Scores: how sure a rule is.
TAG, TITLE, ADDRESS, NOTICE, MENTION, BASE_PLACE = (0, 1.0), (1, 0.95), (2, 0.9), (3, 0.9), (4, 0.8), (5, 0.7)


@dataclass(frozen=True)
class Rule:
    """Every match holds one of the keywords, the spaces beside it counted in, and is at most `reach` characters long."""

    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    reach: int
    priority: int
    score: float


def spelled_out(body: str) -> list[str]:
    """All texts that a pattern of literals, sets, alternatives and options matches."""

    def texts(parsed) -> list[str]:
        out = [""]
        for op, arg in parsed:
            match str(op):
                case "LITERAL":
                    part = [chr(arg)]
                case "IN":
                    part = [chr(c) for _, c in arg]
                case "MAX_REPEAT" if arg[:2] == (0, 1):
                    part = ["", *texts(arg[2])]
                case "BRANCH":
                    part = [t for branch in arg[1] for t in texts(branch)]
                case "SUBPATTERN":
                    part = texts(arg[-1])
                case kind:
                    raise ValueError(f"{kind} in {body}")
            out = [a + b for a in out for b in part]
        return out

    return texts(re._parser.parse(body))


def keywords_of(body: str) -> tuple[str, ...]:
    """The texts that the pattern matches, between spaces and without those that hold a shorter one."""
    kept: list[str] = []
    for text in sorted({f" {t.strip()} " for t in spelled_out(body)}, key=lambda t: (len(t), t)):
        if not any(k in text for k in kept):
            kept.append(text)
    return tuple(kept)


def _rule(label: str, body: str, kind: tuple[int, float], keywords: tuple[str, ...]) -> Rule:
    pattern = re.compile(rf"(?<= )(?:{body})(?= )")
    return Rule(label, keywords, pattern, re._parser.parse(pattern.pattern).getwidth()[1], *kind)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order. Several come from each line of FAMILIES: an SPDX tag, two licensing sentences, a title."""
    rows = lambda block: [[x.strip() for x in line.split(" | ")] for line in block.strip().splitlines()]
    out = []
    for label, spdx, title in rows(FAMILIES):
        named = rf"(?:{title}|(?:{spdx}) licen[cs]e)"
        out.append(_rule(label, rf"spdx license identifier (?:{spdx})", TAG, ("spdx license identifier",)))
        out.append(_rule(label, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{named}", TITLE, keywords_of(named)))
        out.append(_rule(label, rf"licen[cs]ed? (?:under )?(?:the )?(?:{spdx})", TITLE, keywords_of(spdx)))
        out.append(_rule(label, title, MENTION, keywords_of(title)))
    out += [_rule(label, body, ADDRESS, keywords_of(body)) for label, body in rows(ADDRESSES)]
    out += [_rule(label, body, NOTICE, (keyword,)) for label, keyword, body in rows(NOTICES)]
    return tuple(out)


@functools.cache
def _automaton():
    import ahocorasick

    found: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            found.setdefault(word, []).append(i)
    automaton = ahocorasick.Automaton()
    for word, numbers in found.items():
        automaton.add_word(word, tuple(numbers))
    automaton.make_automaton()
    return automaton


def detections(words: str) -> list[tuple[int, int, int, int]]:
    """All matches in " word word ... ": (priority, rule, first character, end). A rule is tried around its keywords alone."""
    regions: dict[int, list[list[int]]] = {}
    for end, numbers in _automaton().iter(words):
        for i in numbers:
            reach = rules()[i].reach + 2
            own = regions.setdefault(i, [])
            if own and own[-1][1] >= end - reach:
                own[-1][1] = end + reach
            else:
                own.append([max(0, end - reach), end + reach])
    return [(rules()[i].priority, i, m.start(), m.end()) for i, own in regions.items() for lo, hi in own for m in rules()[i].pattern.finditer(words, lo, hi)]


def surviving(found: list[tuple[int, int, int, int]]) -> list[int]:
    """Places in `found` of those whose interval lies within that of no survivor before it, in the order of priority,
    length (longest first), rule and place.

    Matches of one priority and length lie within one another only if they are equal, so they are settled together.
    What suppresses is the outline of the survivors, by first character: those that lie in no other, whose ends ascend.
    """
    priority, rule, start, end = np.array(found, dtype=np.int64).reshape(-1, 4).T
    order = np.lexsort((start, rule, start - end, priority))
    rank = np.stack([priority[order], (start - end)[order]])
    cuts = np.flatnonzero(np.any(rank[:, 1:] != rank[:, :-1], axis=0)) + 1
    out, a, b = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some in np.split(order, cuts):
        at = np.searchsorted(a, start[some], side="right") - 1
        free = some[(at < 0) | (b[at] < end[some])] if len(a) else some
        free = free[np.sort(np.unique(start[free], return_index=True)[1])]
        out.append(free)
        a, b = np.concatenate([a, start[free]]), np.concatenate([b, end[free]])
        by = np.lexsort((-b, a))
        a, b = a[by], b[by]
        outline = np.concatenate([[True], b[1:] > np.maximum.accumulate(b)[:-1]]) if len(a) else np.zeros(0, bool)
        a, b = a[outline], b[outline]
    return np.concatenate(out).tolist()


def places(words: str) -> list[tuple[int, int, str, int, float]]:
    """Surviving detections in " word word ... ": (first character, end, label, priority, score), in order of place."""
    found = detections(words)
    if not found:
        return []
    return sorted((found[k][2], found[k][3], rules()[found[k][1]].label, found[k][0], rules()[found[k][1]].score) for k in surviving(found))


def base_places(words: str) -> list[tuple[int, str]]:
    """(first character, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE.items():
        at = words.find(f" {phrase} ")
        while at >= 0:
            out.append((at + 1, label))
            at = words.find(f" {phrase} ", at + 1)
    return sorted(out)


FOUND = fields(
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections:first_word:int,end_word:int,label:string,priority:int"
)
_NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "detections": []}


def scan_words(words: str) -> dict:
    """FOUND without n_words, for the words of one text as " word word ... "."""
    base, kept = base_places(words), places(words)
    if not base and not kept:
        return _NOTHING
    spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)
    word_of = lambda at: (np.searchsorted(spaces, at) - 1).tolist()
    base_labels = sorted({label for _, label in base})
    return {
        "n_base": len(base),
        "first_word": word_of(base[0][0]) if base else None,
        "last_word": word_of(base[-1][0]) if base else None,
        "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *(k[2] for k in kept)})),
        "score": max([BASE_PLACE[1] if base else 0.0, *(k[4] for k in kept)]),
        "detections": [
            {"first_word": a, "end_word": b + 1, "label": label, "priority": p}
            for a, b, (_, _, label, p, _) in zip(word_of([k[0] for k in kept]), word_of([k[1] for k in kept]), kept, strict=True)
        ],
    }


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and FOUND for each row; `detections` are the surviving places, in words."""
    out = T.StructType([df.select(key).schema[0], *FOUND.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = words_of(value.as_py())
                rows.append({"n_words": len(words), **scan_words(f" {b' '.join(words).decode()} ")})
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *[pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return arrow_map(df.select(key, text), work, out)
