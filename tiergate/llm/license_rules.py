"""Signature table of the license scan.

Texts are matched as lower-case words with one space between them ("CC BY-NC 4.0" is "cc by nc 4 0"). A family line
reads: label | keyword | name | SPDX id | address, each of the last three a regular expression over such words (empty:
none). Every family gives up to four ordered rules, most reliable first:

  class 0  "spdx license identifier <id>" and "licensed under the <name>"
  class 1  the address of the license text
  class 2  the name alone
  class 3  general mentions (``GENERAL``: label | keyword | expression)

A rule is tried only on texts that hold its keyword.
"""

from __future__ import annotations

import re

FAMILIES = r"""
mit | mit licen | (?:the )?mit licen[cs]e | mit | opensource org licenses mit
mit | expat licen | (?:the )?expat licen[cs]e | expat | directory fsf org wiki license expat
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)? | mit 0 | github com aws mit 0
x11 | x11 licen | x11 licen[cs]e | x11 | www xfree86 org 3 3 6 copyright2
isc | isc licen | (?:the )?isc licen[cs]e | isc | opensource org licenses isc
0bsd | zero clause bsd | (?:bsd )?zero clause bsd(?: licen[cs]e)? | 0bsd | landley net toybox license
bsd-1 | bsd | bsd 1 clause(?: licen[cs]e)? | bsd 1 clause | opensource org license bsd 1 clause
bsd-2 | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3 | bsd | (?:modified bsd|revised bsd|new bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)? | bsd 4 clause | directory fsf org wiki license bsd 4clause
bsd-patent | bsd | bsd 2 clause plus patent(?: licen[cs]e)? | bsd 2 clause patent | opensource org licenses bsdpluspatent
apache-1 | apache | apache (?:software )?licen[cs]e(?: version)? 1 0 | apache 1 0 | www apache org licenses license 1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e(?: version)? 1 1 | apache 1 1 | www apache org licenses license 1 1
apache-2 | apache | (?:the )?apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)? | apache 2 0 | www apache org licenses license 2 0
gpl-1 | gpl | (?:gnu )?gpl ?v?1(?: 0)? | gpl 1 0(?: only| or later)? | www gnu org licenses old licenses gpl 1 0
gpl-2 | general public | gnu general public licen[cs]e(?: gpl)? (?:version|v) ?2(?: 0)? | gpl 2 0(?: only| or later)? | www gnu org licenses old licenses gpl 2 0
gpl-2 | gpl | (?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)? | gpl 2 | gnu org copyleft gpl 2
gpl-3 | general public | gnu general public licen[cs]e(?: gpl)? (?:version|v) ?3(?: 0)? | gpl 3 0(?: only| or later)? | www gnu org licenses gpl 3 0
gpl-3 | gpl | (?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)? | gpl 3 | gnu org licenses gpl
lgpl-2 | lgpl | (?:gnu )?lgpl ?v?2(?: 0)?(?: only| or later)? | lgpl 2 0(?: only| or later)? | www gnu org licenses old licenses library
lgpl-2 | library general | gnu library general public licen[cs]e(?: (?:version|v) ?2)?(?: 0)? | lgpl 2 | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v?2 1(?: only| or later)? | lgpl 2 1(?: only| or later)? | www gnu org licenses old licenses lgpl 2 1
lgpl-2.1 | lesser general | gnu lesser general public licen[cs]e(?: lgpl)? (?:version|v) ?2 1 | lgpl 2 1 | gnu org licenses lgpl 2 1
lgpl-3 | lgpl | (?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)? | lgpl 3 0(?: only| or later)? | www gnu org licenses lgpl 3 0
lgpl-3 | lesser general | gnu lesser general public licen[cs]e(?: lgpl)? (?:version|v) ?3(?: 0)? | lgpl 3 | gnu org licenses lgpl
agpl-3 | agpl | (?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)? | agpl 3 0(?: only| or later)? | www gnu org licenses agpl 3 0
agpl-3 | affero | gnu affero general public licen[cs]e(?: agpl)? (?:version|v) ?3(?: 0)? | agpl 3 | gnu org licenses agpl
agpl-1 | affero | affero general public licen[cs]e (?:version|v) ?1(?: 0)? | agpl 1 0(?: only| or later)? | www affero org oagpl
gfdl | free documentation | gnu free documentation licen[cs]e(?: (?:version|v) ?1(?: [0-3])?)? | gfdl 1 [1-3](?: only| or later)? | www gnu org licenses fdl
mpl-1 | mozilla public | mozilla public licen[cs]e (?:version|v) ?1(?: [01])? | mpl 1 [01] | www mozilla org mpl mpl 1
mpl-2 | mozilla public | mozilla public licen[cs]e(?: (?:version|v))? ?2(?: 0)? | mpl 2 0 | (?:www )?mozilla org (?:en us )?mpl 2 0
epl-1 | eclipse public | eclipse public licen[cs]e(?: (?:version|v))? ?1(?: 0)? | epl 1 0 | www eclipse org legal epl v10
epl-2 | eclipse public | eclipse public licen[cs]e(?: (?:version|v))? ?2(?: 0)? | epl 2 0 | www eclipse org legal epl 2 0
edl-1 | eclipse distribution | eclipse distribution licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | edl 1 0 | www eclipse org org documents edl v10
cddl-1 | common development and distribution | common development and distribution licen[cs]e(?: cddl)?(?: (?:version|v) ?1(?: [01])?)? | cddl 1 [01] | opensource org licenses cddl 1 0
cpl-1 | common public | common public licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | cpl 1 0 | opensource org licenses cpl 1 0
ipl-1 | ibm public | ibm public licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | ipl 1 0 | opensource org licenses ipl 1 0
eupl | european union public | european union public licen[cs]e(?: (?:version|v) ?1(?: [0-2])?)? | eupl 1 [0-2] | joinup ec europa eu collection eupl
cecill | cecill | cecill(?: [bc])?(?: free software)? licen[cs]e(?: agreement)? | cecill (?:1 0|2 0|2 1|b|c) | www cecill info licences
artistic-1 | artistic | (?:perl )?artistic licen[cs]e(?: (?:version|v))? ?1(?: 0)? | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic license 1 0
artistic-2 | artistic | (?:perl )?artistic licen[cs]e(?: (?:version|v))? ?2(?: 0)? | artistic 2 0 | www perlfoundation org artistic license 2 0
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | (?:www )?zlib net zlib license
libpng | libpng | libpng licen[cs]e | libpng(?: 2 0)? | www libpng org pub png src libpng license
boost-1 | boost software | boost software licen[cs]e(?: (?:version|v))?(?: 1 0)? | bsl 1 0 | www boost org license 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?: (?:version|v) ?2)? | wtfpl | www wtfpl net
wtfpl | want to public | do what the f[a-z]* you want to public licen[cs]e | wtfpl 2 | sam zoy org wtfpl
beerware | beer | beer ?ware licen[cs]e | beerware | people freebsd org phk
openssl | openssl licen | openssl licen[cs]e | openssl | www openssl org source license
ssleay | ssleay | (?:original )?ssleay licen[cs]e | ssleay | www openssl org ssleay
php-3 | php licen | php licen[cs]e(?: (?:version|v) ?3(?: 01?)?)? | php 3 0 1? | www php net license 3 0
python-2 | python software foundation | python software foundation licen[cs]e(?: (?:version|v) ?2)? | (?:psf|python) 2 0 | docs python org 3 license
ruby | ruby | ruby(?: s)? licen[cs]e | ruby | www ruby lang org en about license
tcl | tcl tk licen | tcl tk licen[cs]e | tcl | www tcl tk software tcltk license
vim | vim licen | vim licen[cs]e | vim | vimdoc sourceforge net htmldoc uganda
curl | curl licen | curl licen[cs]e | curl | curl (?:se|haxx se) docs copyright
icu | icu licen | icu licen[cs]e | icu | source icu project org repos icu
unicode | unicode | unicode (?:inc )?licen[cs]e(?: agreement)? | unicode (?:dfs 2015|dfs 2016|3 0) | www unicode org (?:copyright|license)
ntp | ntp licen | ntp licen[cs]e | ntp | opensource org licenses ntp
postgresql | postgresql licen | postgresql licen[cs]e | postgresql | www postgresql org about licence
ms-pl | microsoft public | microsoft public licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses ms rl
osl-3 | open software licen | open software licen[cs]e(?: (?:version|v))?(?: 3(?: 0)?)? | osl 3 0 | opensource org licenses osl 3 0
afl-3 | academic free | academic free licen[cs]e(?: (?:version|v))?(?: 3(?: 0)?)? | afl 3 0 | opensource org licenses afl 3 0
ecl-2 | educational community | educational community licen[cs]e(?: (?:version|v))?(?: 2(?: 0)?)? | ecl 2 0 | opensource org licenses ecl 2 0
ncsa | illinois | university of illinois ncsa open source licen[cs]e | ncsa | otm illinois edu uiuc opensource
upl-1 | universal permissive | universal permissive licen[cs]e(?: (?:version|v))?(?: 1(?: 0)?)? | upl 1 0 | opensource org licenses upl
blueoak | blue oak | blue oak model licen[cs]e(?: 1 0 0)? | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: (?:version|v))?(?: 1 [01])? | ofl 1 [01] | scripts sil org ofl
ofl-1.1 | sil ofl | sil ofl(?: 1 [01])? | ofl | openfontlicense org
lppl | latex project public | latex project public licen[cs]e(?: lppl)?(?: (?:version|v) ?1(?: 3[abc]?)?)? | lppl 1 [0-3][abc]? | www latex project org lppl
qpl | q public | q public licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | qpl 1 0 | doc qt nokia com 3 3 license
sleepycat | sleepycat | sleepycat licen[cs]e | sleepycat | opensource org licenses sleepycat
zpl | zope public | zope public licen[cs]e(?: (?:version|v) ?2(?: [01])?)? | zpl [12] [01] | old zope org resources license zpl
sspl-1 | server side public | server side public licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | sspl 1 0 | www mongodb com licensing server side public license
busl-1.1 | business source | business source licen[cs]e(?: (?:version|v))?(?: 1 1)? | busl 1 1 | mariadb com bsl11
elastic-2 | elastic licen | elastic licen[cs]e(?: (?:version|v))?(?: 2(?: 0)?)? | elastic 2 0 | www elastic co licensing elastic license
commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)? | commons clause | commonsclause com
polyform | polyform | polyform (?:noncommercial|small business|shield|perimeter)(?: licen[cs]e)? | polyform (?:noncommercial|small business) 1 0 0 | polyformproject org licenses
hippocratic | hippocratic | hippocratic licen[cs]e(?: (?:version|v))?(?: [23] [01])? | hippocratic 2 1 | firstdonoharm dev
openrail | rail | (?:creativeml )?(?:big ?science |bigcode )?open ?rail(?: m)? licen[cs]e | (?:creativeml|bigscience) openrail m | huggingface co spaces compvis stable diffusion license
odbl-1 | open database | open (?:data commons open )?database licen[cs]e(?: odbl)?(?: (?:version|v) ?1(?: 0)?)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1 | open data commons attribution | open data commons attribution licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | odc by 1 0 | opendatacommons org licenses by
pddl-1 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl
cdla-permissive | community data | community data licen[cs]e agreement permissive | cdla permissive [12] 0 | cdla (?:dev|io) permissive
cdla-sharing | community data | community data licen[cs]e agreement sharing | cdla sharing 1 0 | cdla (?:dev|io) sharing
ogl-uk | open government | (?:uk )?open government licen[cs]e(?: (?:version|v) ?[123](?: 0)?)? | ogl uk [123] 0 | www nationalarchives gov uk doc open government licence
etalab | licence ouverte | licence ouverte(?: open licence)?(?: (?:version|v) ?[12](?: 0)?)? | etalab 2 0 | www etalab gouv fr licence ouverte
dl-de | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?(?: (?:version )?2 0)? | dl de (?:by|zero) 2 0 | www govdata de dl de
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-pdm | public domain mark | public domain mark(?: 1 0)? | cc pdm 1 0 | creativecommons org publicdomain mark 1 0
cc-by | cc by | cc by(?: [1-4] [05])? | cc by [1-4] [05] | creativecommons org licenses by [1-4] [05]
cc-by | commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by | creativecommons org licenses by
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])? | cc by sa [1-4] [05] | creativecommons org licenses by sa [1-4] [05]
cc-by-sa | commons attribution share | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by sa | creativecommons org licenses by sa
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])? | cc by nc [1-4] [05] | creativecommons org licenses by nc [1-4] [05]
cc-by-nc | commons attribution non | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc | creativecommons org licenses by nc
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])? | cc by nd [1-4] [05] | creativecommons org licenses by nd [1-4] [05]
cc-by-nd | commons attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nd | creativecommons org licenses by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [05])? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa | commons attribution non | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc sa | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [05])? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd | commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)? | cc by nc nd | creativecommons org licenses by nc nd
"""

GENERAL = r"""
gpl | general public | (?:gnu )?general public licen[cs]e
lgpl | lesser general | (?:gnu )?lesser general public licen[cs]e
agpl | affero general | (?:gnu )?affero general public licen[cs]e
gpl | gpl | (?:the )?(?:gnu )?gpl licen[cs]e
lgpl | lgpl | (?:the )?(?:gnu )?lgpl licen[cs]e
agpl | agpl | (?:the )?(?:gnu )?agpl licen[cs]e
bsd | bsd | (?:the )?bsd(?: style)? licen[cs]e
apache | apache | (?:the )?apache (?:software )?licen[cs]e
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
artistic | artistic | (?:the )?artistic licen[cs]e
creative-commons | creative commons | (?:a )?creative commons(?: licen[cs]e)?
public-domain | public domain | (?:released|placed|dedicated)(?: in| into| to) the public domain
public-domain | public domain | this (?:work|file|text|page) is in the public domain
mit | without limitation the rights to use | without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
zlib | this software is provided as is | this software is provided as is without any express or implied warranty
proprietary | all rights reserved | all rights reserved
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution)
proprietary | confidential and proprietary | confidential and proprietary
proprietary | may not be reproduced | may not be reproduced(?: stored)?(?: or)?(?: transmitted| distributed)? without
non-commercial | commercial use | (?:for )?non ?commercial use only
non-commercial | commercial use | not for commercial use
research-only | research | (?:for )?(?:academic and )?research(?: and educational)? (?:use|purposes) only
research-only | academic | (?:for )?academic(?: and educational)? (?:use|purposes) only
"""

_UNDER = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|made available)(?: to you)? under (?:the )?(?:terms of )?(?:the |a )?"


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().split("\n")]


def _whole_words(expression: str) -> str:
    return f"(?<= )(?:{expression})(?= )"


def _literal_start(expression: str) -> str:
    """The plain words that an expression starts with (after an optional "www"): its keyword."""
    return re.match(r"[a-z0-9 ]*[a-z0-9](?![^ ]*[\[(?])", expression.removeprefix("(?:www )?"))[0].strip()


def _stem(name: str, keyword: str) -> str:
    """ "licen" if every match of ``name`` holds it, else the keyword."""
    rest, before = name, ""
    while rest != before:
        before, rest = rest, re.sub(r"\((?:\?:)?[^()]*\)\?", "", rest)
    return "licen" if "licen" in rest and "|" not in rest else keyword


def rules() -> list[dict]:
    """The ordered rules: number, class, label, keyword, expression over " word word ... ", and a stem.

    A text can match a rule only if it holds the rule's keyword and its stem; there are far fewer stems.
    """
    out: list[tuple[int, str, str, str, str]] = []
    for label, keyword, name, spdx, address in _lines(FAMILIES):
        start = _literal_start(address)
        out.append((0, label, "spdx license identifier", f"spdx license identifier {spdx}", "licen"))
        out.append((0, label, keyword, _UNDER + f"(?:{name})", _stem(name, keyword)))
        out.append((1, label, start, address, "www" if start.startswith("www") else " ".join(start.split(" ")[:2])))
        out.append((2, label, keyword, name, _stem(name, keyword)))
    out += [(3, label, keyword, e, _stem(e, keyword)) for label, keyword, e in _lines(GENERAL)]
    out.sort(key=lambda r: r[0])  # stable: table order inside a class
    return [{"num": i, "cls": c, "label": x, "keyword": k, "pattern": _whole_words(e), "stem": s} for i, (c, x, k, e, s) in enumerate(out)]


def stems() -> list[str]:
    """Every stem, without those that hold another one."""
    found = sorted({r["stem"] for r in rules()}, key=lambda s: (len(s), s))
    return [s for i, s in enumerate(found) if not any(short in s for short in found[:i])]
