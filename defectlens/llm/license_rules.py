"""Signature rules of licences: a hand-written name and identifier per licence, in three frames of falling priority.

Patterns run over normalised text: lower-case words of letters and digits with one space between them.
"""

from __future__ import annotations

from typing import NamedTuple

# label | keyword of the name, if all its spellings hold it | identifier | name
LICENSES = r"""
mit | mit | mit | (?:the )?mit (?:x11 )?licen[sc]e
mit-0 | mit | mit 0 | mit no attribution(?: licen[sc]e)?
x11 | x11 | x11 | (?:the )?x11 licen[sc]e
apache-1 | apache | apache 1 [01] | apache (?:software )?licen[sc]e(?: version)? 1 [01]
apache-2 | apache | apache 2 0 | apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?
bsd-1 | bsd | bsd 1 clause | (?:1|one) clause bsd licen[sc]e
bsd-2 | bsd | bsd 2 clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e
bsd-3 | bsd | bsd 3 clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e
bsd-4 | bsd | bsd 4 clause | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]e
0bsd | bsd | 0bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd) licen[sc]e
gpl-1 | gnu | gpl 1 0(?: only| or later)? | gnu general public licen[sc]e (?:version |v)?1
gpl-2 | gnu | gpl 2 0(?: only| or later)? | gnu general public licen[sc]e (?:version |v)?2
gpl-3 | gnu | gpl 3 0(?: only| or later)? | gnu general public licen[sc]e (?:version |v)?3
gpl | gnu | gpl | gnu general public licen[sc]e
lgpl-2 | gnu | lgpl 2 0(?: only| or later)? | gnu library general public licen[sc]e(?: version 2)?
lgpl-2.1 | gnu | lgpl 2 1(?: only| or later)? | gnu lesser general public licen[sc]e (?:version |v)?2 1
lgpl-3 | gnu | lgpl 3 0(?: only| or later)? | gnu lesser general public licen[sc]e (?:version |v)?3
lgpl | gnu | lgpl | gnu lesser general public licen[sc]e
agpl-3 | gnu | agpl 3 0(?: only| or later)? | gnu affero general public licen[sc]e(?: (?:version |v)?3)?
gfdl-1.1 | gnu | gfdl 1 1(?: only| or later)? | gnu free documentation licen[sc]e version 1 1
gfdl-1.2 | gnu | gfdl 1 2(?: only| or later)? | gnu free documentation licen[sc]e version 1 2
gfdl-1.3 | gnu | gfdl 1 3(?: only| or later)? | gnu free documentation licen[sc]e(?: version 1 3)?
mpl-1.0 | mozilla | mpl 1 0 | mozilla public licen[sc]e (?:version |v)?1 0
mpl-1.1 | mozilla | mpl 1 1 | mozilla public licen[sc]e (?:version |v)?1 1
mpl-2.0 | mozilla | mpl 2 0 | mozilla public licen[sc]e (?:version |v)?2(?: 0)?
epl-1.0 | eclipse | epl 1 0 | eclipse public licen[sc]e (?:version |v)?1(?: 0)?
epl-2.0 | eclipse | epl 2 0 | eclipse public licen[sc]e (?:version |v)?2(?: 0)?
cpl-1.0 | common public | cpl 1 0 | common public licen[sc]e(?: version 1 0)?
ipl-1.0 | public | ipl 1 0 | ibm public licen[sc]e(?: version 1 0)?
cddl-1.0 | common development | cddl 1 0 | common development and distribution licen[sc]e(?: version 1 0)?
cddl-1.1 | common development | cddl 1 1 | common development and distribution licen[sc]e version 1 1
cpal-1.0 | common public | cpal 1 0 | common public attribution licen[sc]e(?: version 1 0)?
eupl-1.1 | european | eupl 1 1 | european union public licen[sc]e (?:version |v)?1 1
eupl-1.2 | european | eupl 1 2 | european union public licen[sc]e(?: (?:version |v)?1 2)?
osl-3.0 | open software | osl 3 0 | open software licen[sc]e(?: version 3 0)?
afl-3.0 | academic free | afl 3 0 | academic free licen[sc]e(?: version 3 0)?
artistic-1.0 | artistic | artistic 1 0 | artistic licen[sc]e(?: version)? 1 0
artistic-2.0 | artistic | artistic 2 0 | artistic licen[sc]e(?: version)? 2 0
isc | isc | isc | (?:the )?isc licen[sc]e
zlib | zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng | libpng(?: 2 0)? | (?:the )?libpng licen[sc]e
bsl-1.0 | boost | bsl 1 0 | boost software licen[sc]e(?: version 1 0)?
busl-1.1 | business source | busl 1 1 | business source licen[sc]e(?: 1 1)?
sspl-1.0 | server side | sspl 1 0 | server side public licen[sc]e(?: version 1)?
elastic-2.0 | elastic | elastic 2 0 | elastic licen[sc]e(?: 2 0)?
unlicense | unlicense | unlicense | (?:the )?unlicense
wtfpl | public | wtfpl | do what the fuck you want to public licen[sc]e
cc0-1.0 | cc0 | cc0 1 0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by | cc by | cc by [1234] [05] | (?:cc by|cc by [1234] [05])
cc-by-sa | cc by sa | cc by sa [1234] [05] | cc by sa(?: [1234] [05])?
cc-by-nd | cc by nd | cc by nd [1234] [05] | cc by nd(?: [1234] [05])?
cc-by-nc | cc by nc | cc by nc [1234] [05] | cc by nc(?: [1234] [05])?
cc-by-nc-sa | cc by nc sa | cc by nc sa [1234] [05] | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc by nc nd | cc by nc nd [1234] [05] | cc by nc nd(?: [1234] [05])?
cc-by | creative commons | cc by | creative commons attribution (?:[1234] [05] )?(?:international |unported )?licen[sc]e
cc-by-sa | creative commons | cc by sa | creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd | creative commons | cc by nd | creative commons attribution no ?derivatives(?: [1234] [05])?
cc-by-nc | creative commons | cc by nc | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nc-sa | creative commons | cc by nc sa | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd | creative commons | cc by nc nd | creative commons attribution non ?commercial no ?derivatives(?: [1234] [05])?
odbl-1.0 | open database | odbl 1 0 | open database licen[sc]e(?: v?1 0)?
odc-by-1.0 | open data commons | odc by 1 0 | open data commons attribution licen[sc]e
pddl-1.0 | open data commons | pddl 1 0 | open data commons public domain dedication and licen[sc]e
ofl-1.1 | sil | ofl 1 1 | sil open font licen[sc]e(?: version 1 1)?
psf-2.0 | python | psf 2 0 | (?:python software foundation|psf) licen[sc]e(?: version 2)?
ruby | ruby | ruby | ruby licen[sc]e
php-3.01 | php | php 3 01? | php licen[sc]e(?: version 3 01?)?
ncsa | ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
postgresql | postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl | openssl licen[sc]e
ms-pl | microsoft | ms pl | microsoft public licen[sc]e
ms-rl | microsoft | ms rl | microsoft reciprocal licen[sc]e
lppl-1.3c | latex | lppl 1 3c | latex project public licen[sc]e(?: version 1 3c)?
ecl-2.0 | educational | ecl 2 0 | educational community licen[sc]e(?: version 2 0)?
upl-1.0 | universal permissive | upl 1 0 | universal permissive licen[sc]e(?: version 1 0)?
mulan-2 | mulan | mulanpsl 2 0 | mulan permissive software licen[sc]e(?: version 2)?
wxwindows | wxwindows | wxwindows | wxwindows library licen[sc]e
vim | vim | vim | vim licen[sc]e
sleepycat | sleepycat | sleepycat | sleepycat licen[sc]e
openrail | openrail | openrail | (?:creativeml )?open ?rail(?: m)? licen[sc]e
public-domain | public domain | public domain | (?:in|into|to) the public domain
all-rights-reserved | reserved | noassertion | all rights reserved
"""

GRANT = r"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|dual licen[sc]ed) under (?:the |an? )?(?:terms of (?:the )?)?"
SPDX = r"spdx licen[sc]e identifier "

# Base phrases by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


class Rule(NamedTuple):
    label: str
    stem: str  # must occur for any rule of the stem to be looked at
    keyword: str  # must occur for this rule to be tried
    tier: int  # 0 comes first
    pattern: str


STEMS = ("licen", "spdx", " under ", "cc by", "cc0", "public domain", "rights reserved", "creative commons", "mit no attribution")
SCORES = (1.0, 0.9, 0.6)  # by tier


def spellings(pattern: str) -> set[str]:
    """All texts that a pattern of letters, (?:a|b), [ab] and ? matches."""

    def either(at: int) -> tuple[set[str], int]:
        found, row = set(), {""}
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                found, row, at = found | row, {""}, at + 1
                continue
            if pattern.startswith("(?:", at):
                some, at = either(at + 3)
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                some, at = set(pattern[at + 1 : end]), end + 1
            else:
                some, at = {pattern[at]}, at + 1
            if pattern.startswith("?", at):
                some, at = some | {""}, at + 1
            row = {a + b for a in row for b in some}
        return found | row, at

    return either(0)[0]


def shared_literal(texts: set[str]) -> str:
    """The longest text that all of them contain."""
    short = min(texts, key=len)
    parts = (short[a : a + n] for n in range(len(short), 0, -1) for a in range(len(short) - n + 1))
    return next(p for p in parts if all(p in t for t in texts))


def rules() -> list[Rule]:
    """Identifier, granted name, granted identifier and bare name of each licence, in the order of the table.

    Whatever a rule's pattern matches contains its stem and its keyword.
    """
    found = []
    for line in LICENSES.strip().splitlines():
        label, keyword, identifier, name = (part.strip() for part in line.split(" | "))
        names, of_identifier = spellings(name), shared_literal(spellings(identifier))
        of_name = keyword if all(keyword in n for n in names) else shared_literal(names)
        bare = next(s for s in STEMS if all(s in n for n in names))
        found.append(Rule(label, "spdx", of_identifier, 0, SPDX + f"(?:{identifier})"))
        found.append(Rule(label, " under ", of_name, 1, GRANT + f"(?:{name})"))
        found.append(Rule(label, " under ", of_identifier, 1, GRANT + f"(?:{identifier})"))
        found.append(Rule(label, bare, of_name, 2, name))
    return found
