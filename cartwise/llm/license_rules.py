"""Signature rules of the license scan.

A rule matches the text's words, lower-cased, joined by single spaces, with a
space in front and behind; its pattern starts with the space before its first
word. The families below are written by hand; versions, ``or later`` grants
and identifier tags follow from them by rule.

``priority``: lower wins between equal intervals. ``weight``: how sure the
rule is, 0 to 1.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str        # literal that every match holds
    pattern: str
    label: str
    priority: int
    weight: float


#: label, names, versions
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu general public licence", "gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license",
              "lesser general public license", "gnu lgpl", "lgpl"], ["2", "2.1", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"],
     ["1", "3"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache license", "apache licence", "apache software license"], ["1.0", "1.1", "2.0"]),
    ("mit", ["mit license", "mit licence", "expat license", "x11 license"], []),
    ("bsd", ["bsd license", "bsd licence", "berkeley software distribution license"], []),
    ("bsd-0-clause", ["bsd 0 clause", "0bsd", "zero clause bsd"], []),
    ("bsd-1-clause", ["bsd 1 clause", "1 clause bsd"], []),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd license",
                      "freebsd license"], []),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd license",
                      "modified bsd license", "revised bsd license"], []),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "four clause bsd", "original bsd license"], []),
    ("mpl", ["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license", "epl"], ["1.0", "2.0"]),
    ("eupl", ["european union public licence", "european union public license", "eupl"], ["1.0", "1.1", "1.2"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], ["1.0"]),
    ("ipl", ["ibm public license"], ["1.0"]),
    ("artistic", ["artistic license", "clarified artistic license"], ["1.0", "2.0"]),
    ("osl", ["open software license"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"]),
    ("bsl", ["boost software license"], ["1.0"]),
    ("busl", ["business source license"], ["1.1"]),
    ("sspl", ["server side public license", "sspl"], ["1"]),
    ("elastic", ["elastic license"], ["1.0", "2.0"]),
    ("odbl", ["open database license", "odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution license"], ["1.0"]),
    ("pddl", ["public domain dedication and license", "pddl"], ["1.0"]),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("isc", ["isc license", "isc licence"], []),
    ("unlicense", ["the unlicense", "unlicense license"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["1", "2"]),
    ("psf", ["python software foundation license", "psf license"], ["2"]),
    ("php", ["php license"], ["3.0", "3.01"]),
    ("ruby", ["ruby license"], []),
    ("postgresql", ["postgresql license"], []),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], []),
    ("openssl", ["openssl license"], []),
    ("w3c", ["w3c software license", "w3c software notice and license"], []),
    ("ms-pl", ["microsoft public license", "ms pl"], []),
    ("ms-rl", ["microsoft reciprocal license", "ms rl"], []),
    ("cecill", ["cecill free software license agreement", "cecill license", "cecill"], ["1.0", "2.0", "2.1"]),
    ("mulan-psl", ["mulan permissive software license", "mulan psl"], ["1", "2"]),
    ("upl", ["universal permissive license"], ["1.0"]),
    ("qpl", ["q public license"], ["1.0"]),
    ("lppl", ["latex project public license", "lppl"], ["1.0", "1.1", "1.2", "1.3"]),
    ("ogl-uk", ["open government licence", "open government license"], ["1.0", "2.0", "3.0"]),
    ("cc0", ["cc0", "cc zero", "creative commons zero"], ["1.0"]),
    ("public-domain-mark", ["public domain mark"], ["1.0"]),
    ("llama", ["llama community license", "llama 2 community license", "llama 3 community license"], []),
    ("openrail", ["openrail m", "open rail m", "responsible ai license"], []),
]

#: Creative Commons: label part, name in words, name in full words.
CC_KINDS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Sentences of license texts and notices: keyword, pattern, label, weight.
SENTENCES = [
    ("permission is hereby granted", " permission is hereby granted free of charge to any person obtaining a copy"
     "(?: of this software(?: and associated documentation files)?)?", "mit", 0.95),
    ("copies or substantial portions", " (?:all|in all) copies or substantial portions of the software", "mit", 0.8),
    ("redistribution and use in source", " redistribution and use in source and binary forms(?: with or without"
     " modification)?(?: are permitted)?", "bsd", 0.9),
    ("nor the names of its contributors", " neither the names? of(?: \\S+){1,12} nor the names of its contributors",
     "bsd-3-clause", 0.95),
    ("all advertising materials", " all advertising materials mentioning features or use of this software",
     "bsd-4-clause", 0.95),
    ("except in compliance with the license", " you may not use this file except in compliance with the license",
     "apache-2.0", 0.95),
    ("apache org licenses license 2 0", " apache org licenses license 2 0", "apache-2.0", 1.0),
    ("this program is free software", " this program is free software you can redistribute it and or modify it",
     "gpl", 0.9),
    ("this library is free software", " this library is free software you can redistribute it and or modify it",
     "lgpl", 0.9),
    ("subject to the terms of the mozilla", " this source code form is subject to the terms of the mozilla public"
     " license v 2 0", "mpl-2.0", 1.0),
    ("permission to use copy modify", " permission to use copy modify and(?: or)? distribute this software"
     "(?: and its documentation)? for any purpose", "isc", 0.85),
    ("altered source versions", " altered source versions must be plainly marked as such", "zlib", 0.95),
    ("free and unencumbered software", " this is free and unencumbered software released into the public domain",
     "unlicense", 1.0),
    ("public domain", " (?:dedicated to|released (?:in)?to|placed in|in|is) the public domain", "public-domain", 0.6),
    ("all rights reserved", " all rights reserved", "all-rights-reserved", 0.4),
    ("confidential and proprietary", " confidential and proprietary", "proprietary", 0.6),
    ("creative commons", " creative commons", "cc", 0.5),
    ("apache org licenses", " apache org licenses", "apache", 0.8),
    ("gnu org licenses", " gnu org licenses", "gnu", 0.6),
    ("opensource org licenses mit", " opensource org licenses mit", "mit", 1.0),
    ("opensource org licenses", " opensource org licenses", "osi", 0.6),
    ("end user license agreement", " end user license agreement", "eula", 0.6),
    ("non commercial use only", " (?:for )?non commercial use only", "non-commercial", 0.6),
    ("no license", " no license (?:is )?granted", "no-license", 0.5),
]

FULL_STOP = r"(?= )(?! \d)"


def _version(version: str) -> str:
    major, _, minor = version.partition(".")
    tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
    return rf"(?: license| licence)?,? (?:version |ver |v |v)?{major}{tail}{FULL_STOP}"


def _tag(label: str) -> str:
    return " " + re.sub(r"[^a-z0-9]+", " ", label)


def build_rules() -> list[Rule]:
    rules = []
    tags: dict[str, None] = {}
    for label, names, versions in FAMILIES:
        tags[label] = None
        for name in names:
            word = f" {name}"
            rules.append(Rule(word, f"{word}(?= )", label, 40, 0.8 if " " in name else 0.6))
            for v in versions:
                own = f"{label}-{v}"
                tags[own] = tags[f"{own}-only"] = tags[f"{own}-or-later"] = None
                rules.append(Rule(word, word + _version(v), own, 20, 0.95))
                rules.append(Rule(word, word + _version(v) + r"(?: of the license)? or(?: at your option)?"
                                  r"(?: \(?any)? later(?: version)?(?= )", f"{own}-or-later", 10, 1.0))
    for kind, short, long in CC_KINDS:
        label = f"cc-{kind}"
        tags[label] = None
        forms = [(f" cc {short}", f" cc {short}"), (" creative commons", f" creative commons {long}"),
                 ("creativecommons org licenses", f" creativecommons org licenses {short}")]
        for keyword, form in forms:
            rules.append(Rule(keyword, f"{form}(?= )", label, 40, 0.8))
            for v in CC_VERSIONS:
                tags[f"{label}-{v}"] = None
                place = "(?: international| unported| generic)?"
                rules.append(Rule(keyword, form + place + _version(v), f"{label}-{v}", 20, 0.95))
    rules += [Rule(" spdx license identifier", f" spdx license identifier{_tag(t)}(?= )", t, 15, 1.0) for t in tags]
    rules += [Rule(k, p + "(?= )", label, 30, w) for k, p, label, w in SENTENCES]
    return rules


#: A text without any of these holds no rule's keyword.
STEMS = ["licen", "gpl", " cc", "creative", "gnu ", "apache org", "bsd", "mpl ", "epl ", "eupl", "cddl", "sspl",
         "odbl", "pddl", "wtfpl", "lppl", "gfdl", " ms ", "cecill", "mulan", "psl", "rail", "public domain", "0bsd",
         "permission ", "redistribution and", "contributors", "advertising materials", "substantial portions",
         "is free software", "source versions", " mozilla", "unencumbered", "rights reserved", "proprietary",
         "commercial use only"]
