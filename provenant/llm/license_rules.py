"""Signature rules of licences: expressions over words in lower case, in the order of their priority.

`NAMES` and `SENTENCES` are written by hand, a line each: label, words that must all be in a text before the expression is
tried, expression. A blank in an expression stands between two words, `[^ ]+` is any word. More specific names come first.
Each name gives two rules, "licensed under ..." and the bare name; each label an identifier tag.
"""

from __future__ import annotations

import re
from typing import NamedTuple

NAMES = """
agpl-3.0-or-later | gnu affero later | gnu affero general public license(?: (?:version|v))? v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
agpl-3.0 | gnu affero | gnu affero general public license(?: (?:version|v))? v?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | agpl | agpl(?: (?:version|v))? v?3(?: 0)?
agpl | gnu affero | gnu affero general public license
agpl | agpl | agpl
lgpl-3.0-or-later | gnu lesser later | gnu lesser general public license(?: (?:version|v))? v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
lgpl-3.0 | gnu lesser | gnu lesser general public license(?: (?:version|v))? v?3(?: 0)?
lgpl-3.0 | lgplv3 | lgplv3
lgpl-3.0 | lgpl | lgpl(?: (?:version|v))? v?3(?: 0)?
lgpl-2.1-or-later | gnu lesser later | gnu lesser general public license(?: (?:version|v))? v?2 1 or(?: at your option)?(?: any)? later(?: version)?
lgpl-2.1 | gnu lesser | gnu lesser general public license(?: (?:version|v))? v?2 1
lgpl-2.1 | lgpl | lgpl(?: (?:version|v))? v?2 1
lgpl-2.0 | gnu library | gnu library general public license(?: (?:version|v))? v?2(?: 0)?
lgpl | gnu lesser | gnu lesser general public license
lgpl | gnu library | gnu library general public license
lgpl | lgpl | lgpl
gpl-3.0-or-later | gnu general later | gnu general public license(?: (?:version|v))? v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0 | gnu general | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: (?:version|v))? v?3(?: 0)?
gpl-3.0 | gplv3 | gplv3
gpl-3.0 | gpl | gpl(?: (?:version|v))? v?3(?: 0)?
gpl-2.0-or-later | gnu general later | gnu general public license(?: (?:version|v))? v?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-2.0 | gnu general | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: (?:version|v))? v?2(?: 0)?
gpl-2.0 | gplv2 | gplv2
gpl-2.0 | gpl | gpl(?: (?:version|v))? v?2(?: 0)?
gpl-1.0 | gnu general | gnu general public license(?: (?:version|v))? v?1(?: 0)?
gfdl-1.3 | gnu free documentation | gnu free documentation license(?: (?:version|v))? v?1 3
gfdl-1.2 | gnu free documentation | gnu free documentation license(?: (?:version|v))? v?1 2
gfdl | gnu free documentation | gnu free documentation license
gfdl | gfdl | gfdl
apache-2.0 | apache | apache(?: software)? license(?: (?:version|v))? v?2(?: 0)?
apache-2.0 | apache | apache v?2(?: 0)?
apache-1.1 | apache | apache(?: software)? license(?: (?:version|v))? v?1 1
apache-1.0 | apache | apache(?: software)? license(?: (?:version|v))? v?1 0
apache | apache software | apache software license
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4(?: 0)?
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3(?: 0)?
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?derivatives
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4(?: 0)?
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3(?: 0)?
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0 | cc by nc | cc by nc 4(?: 0)?
cc-by-nc-3.0 | cc by nc | cc by nc 3(?: 0)?
cc-by-nc-2.0 | cc by nc | cc by nc 2(?: [05])?
cc-by-nc | cc by nc | cc by nc
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
cc-by-nd-4.0 | cc by nd | cc by nd 4(?: 0)?
cc-by-nd | cc by nd | cc by nd
cc-by-nd | creative commons attribution | creative commons attribution no ?derivatives
cc-by-sa-4.0 | cc by sa | cc by sa 4(?: 0)?
cc-by-sa-3.0 | cc by sa | cc by sa 3(?: 0)?
cc-by-sa-2.5 | cc by sa | cc by sa 2 5
cc-by-sa | cc by sa | cc by sa
cc-by-sa | creative commons attribution | creative commons attribution share ?alike
cc-by-4.0 | cc by | cc by 4(?: 0)?
cc-by-4.0 | creative commons attribution | creative commons attribution 4 0
cc-by-3.0 | cc by | cc by 3(?: 0)?
cc-by-3.0 | creative commons attribution | creative commons attribution 3 0
cc-by-2.0 | cc by | cc by 2(?: [05])?
cc-by | creative commons attribution | creative commons attribution
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | creative commons zero
cc-pdm-1.0 | public domain mark | public domain mark(?: 1 0)?
cc | creative commons license | creative commons license
mit-0 | mit attribution | mit no attribution(?: license)?
mit-0 | mit | mit 0
mit-modern | mit modern | mit license modern variant
mit | mit | mit licen[cs]e
mit | expat | expat licen[cs]e
mit | x11 | x11 licen[cs]e
bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?
bsd-4-clause | bsd original | original bsd licen[cs]e
bsd-3-clause-clear | bsd clear | bsd 3 clause clear(?: licen[cs]e)?
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | bsd | 3 clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd new | new bsd licen[cs]e
bsd-3-clause | bsd modified | modified bsd licen[cs]e
bsd-2-clause-patent | bsd patent | bsd 2 clause(?: plus)? patent(?: licen[cs]e)?
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | bsd | 2 clause bsd(?: licen[cs]e)?
bsd-2-clause | bsd simplified | simplified bsd licen[cs]e
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-1-clause | bsd | bsd 1 clause(?: licen[cs]e)?
0bsd | 0bsd | 0bsd
0bsd | bsd zero | zero clause bsd(?: licen[cs]e)?
bsd | bsd | bsd(?: style)? licen[cs]e
isc | isc | isc licen[cs]e
mpl-2.0 | mozilla | mozilla public license(?: (?:version|v))? v?2(?: 0)?
mpl-2.0 | mpl | mpl(?: (?:version|v))? v?2(?: 0)?
mpl-1.1 | mozilla | mozilla public license(?: (?:version|v))? v?1 1
mpl-1.1 | mpl | mpl(?: (?:version|v))? v?1 1
mpl | mozilla | mozilla public license
epl-2.0 | eclipse | eclipse public license(?: (?:version|v))? v?2(?: 0)?
epl-1.0 | eclipse | eclipse public license(?: (?:version|v))? v?1(?: 0)?
epl | eclipse | eclipse public license
edl-1.0 | eclipse distribution | eclipse distribution license(?: (?:version|v))?(?: v?1(?: 0)?)?
cddl-1.1 | cddl | cddl(?: (?:version|v))? v?1 1
cddl-1.0 | cddl | cddl(?: (?:version|v))? v?1 0
cddl | common development distribution | common development and distribution license
cpl-1.0 | common public license | common public license(?: (?:version|v))?(?: v?1 0)?
ipl-1.0 | ibm | ibm public license(?: (?:version|v))?(?: v?1 0)?
eupl-1.2 | eupl | eupl(?: (?:version|v))? v?1 2
eupl-1.1 | eupl | eupl(?: (?:version|v))? v?1 1
eupl | european union public | european union public licen[cs]e
eupl | eupl | eupl
bsl-1.0 | boost | boost software license(?: (?:version|v))?(?: v?1 0)?
busl-1.1 | business source | business source license(?: (?:version|v))?(?: v?1 1)?
sspl-1.0 | server side public | server side public license(?: (?:version|v))?(?: v?1)?
elastic-2.0 | elastic | elastic license(?: (?:version|v))? v?2(?: 0)?
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e
libtiff | libtiff | libtiff licen[cs]e
artistic-2.0 | artistic | artistic licen[cs]e(?: (?:version|v))? v?2(?: 0)?
artistic-1.0 | artistic | artistic licen[cs]e(?: (?:version|v))? v?1(?: 0)?
artistic | artistic | artistic licen[cs]e
perl | perl | same terms as perl(?: itself)?
psf-2.0 | python software foundation | python software foundation license(?: (?:version|v))?(?: v?2(?: 0)?)?
php-3.01 | php | php licen[cs]e(?: (?:version|v))? v?3 01
php-3.0 | php | php licen[cs]e(?: (?:version|v))? v?3(?: 0)?
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e
openssl | openssl | openssl licen[cs]e
ssleay | ssleay | ssleay licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
ofl-1.1 | sil open font | sil open font license(?: (?:version|v))?(?: v?1 1)?
ofl-1.1 | ofl | ofl(?: (?:version|v))? v?1 1
ufl-1.0 | ubuntu font | ubuntu font licen[cs]e(?: (?:version|v))?(?: v?1 0)?
odbl-1.0 | open database license | open database license(?: (?:version|v))?(?: v?1 0)?
odbl-1.0 | odbl | odbl
odc-by-1.0 | open data commons attribution | open data commons attribution license
pddl-1.0 | public domain dedication license | public domain dedication and license(?: pddl)?
cdla-permissive-2.0 | community data license permissive | community data license agreement permissive(?: (?:version|v))? v?2(?: 0)?
cdla-sharing-1.0 | community data license sharing | community data license agreement sharing
ogl-uk-3.0 | open government licence | open government licence(?: (?:version|v))? v?3(?: 0)?
ogl-uk | open government licence | open government licence
etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?: (?:version|v))? v?2(?: 0)?
cecill-2.1 | cecill | cecill(?: free software license agreement)?(?: (?:version|v))? v?2 1
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
cecill | cecill | cecill
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
apsl-2.0 | apple public source | apple public source license(?: (?:version|v))?(?: v?2(?: 0)?)?
osl-3.0 | open software license | open software license(?: (?:version|v))?(?: v?3 0)?
afl-3.0 | academic free license | academic free license(?: (?:version|v))?(?: v?3 0)?
ecl-2.0 | educational community license | educational community license(?: (?:version|v))?(?: v?2 0)?
upl-1.0 | universal permissive license | universal permissive license(?: (?:version|v))?(?: v?1 0)?
ncsa | ncsa | (?:university of illinois )?ncsa open source license
vim | vim | vim licen[cs]e
w3c | w3c | w3c software(?: notice and)?(?: document)? licen[cs]e
zpl-2.1 | zope | zope public license(?: (?:version|v))?(?: v?2 1)?
qpl-1.0 | license public | q public license(?: (?:version|v))?(?: v?1 0)?
lppl-1.3c | latex project public | latex project public license(?: (?:version|v))?(?: v?1 3c?)?
beerware | beer ware | beer ware license
jsond | json | json licen[cs]e
mulanpsl-2.0 | mulan | mulan permissive software license(?: (?:version|v))?(?: v?2)?
openrail | openrail | openrail(?: m)?(?: licen[cs]e)?
openrail | open rail | open rail(?: m)?(?: licen[cs]e)?
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
commons-clause | commons clause | commons clause licen[cs]e condition(?: v1 0)?
"""

SENTENCES = r"""
mit | permission charge software associated | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | software provided warranty | the software is provided as is without warranty of any kind express or implied
isc | permission modify distribute purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2.0 | apache compliance licensed | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | apache january | apache license version 2 0 january 2004
apache-2.0 | unless law agreed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | redistribute foundation gnu | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-3.0-or-later | gnu later foundation | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | gnu later foundation | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl | received gnu along | you should have received a copy of the gnu general public license along with
lgpl | received gnu lesser | you should have received a copy of the gnu lesser general public license along with
agpl | received gnu affero | you should have received a copy of the gnu affero general public license along with
bsd | redistribution binary modification | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | neither endorse contributors | neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
mpl-2.0 | source mozilla subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | contents mozilla subject | the contents of this file are subject to the mozilla public license version 1 1
epl | accompanying eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
bsl-1.0 | boost distributed | distributed under the boost software license version 1 0
unlicense | unencumbered public domain | this is free and unencumbered software released into the public domain
zlib | altered misrepresented plainly | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
ofl-1.1 | font software sil | this font software is licensed under the sil open font license
cc0-1.0 | copyright neighboring possible | to the extent possible under law(?: [^ ]+){1,20} waived all copyright and related or neighboring rights
cc | creative commons licensed | this work is licensed under a creative commons
artistic | perl redistribute itself | you can redistribute it and or modify it under the same terms as perl itself
psf-2.0 | python psf organization | between the python software foundation psf and the individual or organization
openssl | openssl toolkit developed | this product includes software developed by the openssl project for use in the openssl toolkit
beerware | beer buy return | you can buy me a beer in return
jsond | shall evil good | the software shall be used for good not evil
proprietary | proprietary confidential | proprietary and confidential
proprietary | unauthorized copying prohibited | unauthorized copying of this file via any medium is strictly prohibited
all-rights-reserved | rights reserved | all rights reserved
public-domain | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | public domain | this work is in the public domain
cc-by-nc-nd | creativecommons org nd | creativecommons org licenses by nc nd(?: \d \d)?
cc-by-nc-sa | creativecommons org sa | creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc | creativecommons org nc | creativecommons org licenses by nc(?: \d \d)?
cc-by-nd | creativecommons org nd | creativecommons org licenses by nd(?: \d \d)?
cc-by-sa | creativecommons org sa | creativecommons org licenses by sa(?: \d \d)?
cc-by | creativecommons org by | creativecommons org licenses by(?: \d \d)?
cc | creativecommons org | creativecommons org licenses
cc0-1.0 | creativecommons org zero | creativecommons org publicdomain zero(?: 1 0)?
apache-2.0 | apache org licenses | apache org licenses license 2 0
gpl | gnu org licenses | gnu org licenses gpl
lgpl | gnu org licenses | gnu org licenses lgpl
agpl | gnu org licenses | gnu org licenses agpl
mit | opensource org licenses mit | opensource org licenses mit(?: license)?
bsd-3-clause | opensource org licenses bsd | opensource org licenses bsd 3 clause
bsd-2-clause | opensource org licenses bsd | opensource org licenses bsd 2 clause
isc | opensource org licenses isc | opensource org licenses isc(?: license)?
mpl-2.0 | mozilla org mpl | mozilla org(?: en us)? mpl 2 0
epl-2.0 | eclipse org epl | eclipse org legal epl 2 0
unlicense | unlicense org | unlicense org
"""


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]  # all of them are words of a text in which the rule can match
    pattern: str  # over words, each with a blank before and after it
    weight: float  # how sure a match is


def over_words(expression: str) -> str:
    """An expression for texts in which each word has a blank of its own on both sides, so that matches that follow each
    other share none."""
    return " " + expression.replace(" ", "  ") + " "


def _table(lines: str) -> list[tuple[str, tuple[str, ...], str]]:
    rows = [line.split(" | ") for line in lines.strip().split("\n")]
    return [(label, tuple(keys.split()), expression.replace(" ?", "(?: )?")) for label, keys, expression in rows]


def _rules() -> list[Rule]:
    names, sentences = _table(NAMES), _table(SENTENCES)
    labels = dict.fromkeys(label for label, *_ in names + sentences)
    tags = [(x, ("spdx", "identifier"), "spdx license identifier " + " ".join(re.split(r"[-.]", x))) for x in sorted(labels, key=len, reverse=True)]
    under = r"(?:licen[cs]ed|released|distributed|available|published) under(?: the)?(?: terms (?:of|and conditions of))?(?: the)? "
    notices = [(label, (*keys, "under"), under + expression) for label, keys, expression in names]
    forms = ((tags, 1.0), (sentences, 0.9), (notices, 0.95), (names, 0.6))
    return [Rule(label, keys, over_words(expression), weight) for form, weight in forms for label, keys, expression in form]


#: In the order of priority: a match within one of an earlier rule goes.
RULES = _rules()
