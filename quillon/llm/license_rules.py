"""The signature rules of the licence scan.

A rule is a regular expression over normalised text: lower-case words separated
by one space ("version 2.0" reads "version 2 0"). Most signatures are written by hand:
names here, whole sentences in license_sentences. Versions and clauses of named
families are filled in.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from .license_sentences import SENTENCES


class Rule(NamedTuple):
    label: str
    keyword: str  # a rule is tried only on texts that contain it
    regex: str
    priority: int  # 1 beats 4
    weight: float  # how sure a hit is, 0 to 1
    base: bool = False


#: The four base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words that are too common to tell a licence text.
COMMON = "a an and any are as at be by copy file for free good if in is it law library make may must name no not of on or person persons program project property purpose release same see shall software some source that the their these this to under use used version with without work works you your".split()

#: Families with versions: label, keyword, forms of the name, versions.
VERSIONED = [
    ("gpl", "general public licen", "(?:gnu )?general public licen[cs]e", ["1.0", "2.0", "3.0"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lesser general public licen", "(?:gnu )?lesser general public licen[cs]e", ["2.0", "2.1", "3.0"]),
    ("lgpl", "library general public licen", "(?:gnu )?library general public licen[cs]e", ["2.0", "2.1"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2.0", "2.1", "3.0"]),
    ("agpl", "affero general public licen", "(?:gnu )?affero general public licen[cs]e", ["1.0", "3.0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1.0", "3.0"]),
    ("gfdl", "free documentation licen", "(?:gnu )?free documentation licen[cs]e", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla public licen", "mozilla public licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse public licen", "eclipse public licen[cs]e", ["1.0", "2.0"]),
    ("cddl", "common development and distribution licen", "common development and distribution licen[cs]e", ["1.0", "1.1"]),
    ("cpl", "common public licen", "common public licen[cs]e", ["1.0"]),
    ("eupl", "european union public licen", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic licen", "artistic licen[cs]e", ["1.0", "2.0"]),
    ("ofl", "open font licen", "(?:sil )?open font licen[cs]e", ["1.0", "1.1"]),
    ("osl", "open software licen", "open software licen[cs]e", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic free licen", "academic free licen[cs]e", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("php", "php licen", "php licen[cs]e", ["3.0", "3.01"]),
    ("zpl", "zope public licen", "zope public licen[cs]e", ["1.1", "2.0", "2.1"]),
    ("lppl", "latex project public licen", "latex project public licen[cs]e", ["1.0", "1.2", "1.3"]),
    ("odbl", "open database licen", "open database licen[cs]e", ["1.0"]),
    ("cecill", "cecill", "cecill", ["1.0", "2.0", "2.1"]),
    ("bsl", "boost software licen", "boost software licen[cs]e", ["1.0"]),
]

#: Families without versions: label, keyword, expression, priority, weight.
PLAIN = [
    ("mit", "mit licen", "(?:the )?mit licen[cs]e", 3, 0.9),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
    ("mit-0", "mit no attribution", "mit no attribution", 2, 0.9),
    ("isc", "isc licen", "isc licen[cs]e", 3, 0.9),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", 2, 0.95),
    ("bsd-0-clause", "0 clause", "(?:bsd 0 clause|0 clause bsd)", 2, 0.9),
    ("bsd-1-clause", "1 clause", "(?:bsd 1 clause|1 clause bsd)", 2, 0.9),
    ("bsd-2-clause", "2 clause", "(?:bsd 2 clause|2 clause bsd)", 2, 0.9),
    ("bsd-3-clause", "3 clause", "(?:bsd 3 clause|3 clause bsd)", 2, 0.9),
    ("bsd-4-clause", "4 clause", "(?:bsd 4 clause|4 clause bsd)", 2, 0.9),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-3-clause", "new bsd", "new bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd", "bsd licen", "bsd licen[cs]e", 3, 0.8),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms", 2, 0.9),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e", 2, 0.9),
    ("unlicense", "free and unencumbered", "free and unencumbered software released into the public domain", 2, 0.95),
    ("wtfpl", "wtfpl", "wtfpl", 2, 0.9),
    ("wtfpl", "you want to public licen", "do what the \\w+ you want to public licen[cs]e", 2, 0.95),
    ("zlib", "zlib licen", "zlib licen[cs]e", 3, 0.9),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2, 0.95),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", 3, 0.7),
    ("psf-2.0", "python software foundation licen", "python software foundation licen[cs]e", 2, 0.9),
    ("ms-pl", "microsoft public licen", "microsoft public licen[cs]e", 2, 0.9),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e", 2, 0.9),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", 2, 0.9),
    ("openssl", "openssl licen", "openssl licen[cs]e", 2, 0.9),
    ("ruby", "ruby licen", "ruby licen[cs]e", 2, 0.9),
    ("odc-by", "open data commons attribution licen", "open data commons attribution licen[cs]e", 2, 0.9),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[cs]e", 2, 0.9),
    ("proprietary", "all rights reserved", "all rights reserved", 4, 0.5),
    ("licensed", "licensed under", "(?:is |are )?licensed under the terms of", 4, 0.3),
]

#: Creative Commons: clauses by short name, and the versions.
CLAUSES = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?deriv(?:ative)?s(?: works)?",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def gates(keywords: set[str]) -> list[str]:
    """Few strings of which every keyword, with a space before it, contains one: again and again the word that most of the remaining keywords hold."""
    left, chosen = {k: {w for w in k.split() if w not in COMMON} or set(k.split()) for k in keywords}, []
    while left:
        counts = Counter(w for words in left.values() for w in words)
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        chosen.append(" " + best)
        left = {k: words for k, words in left.items() if chosen[-1] not in " " + k}
    return chosen


def _number(version: str) -> str:
    """2.0 is written "2" or "2 0"; 2.1 only "2 1"."""
    major, minor = version.split(".")
    return f"v?{major}(?: 0)?" if minor == "0" else f"v?{major} {minor}"


def _ending(version: str) -> str:
    """Not followed by a further digit group, or 2.0 would be found in 2.0.1."""
    return "(?! \\d)" if version else ""


def rules() -> list[Rule]:
    out = [Rule(label, phrase, phrase, 4, 0.5, True) for phrase, label in BASE.items()]
    for label, keyword, name, versions in VERSIONED:
        out.append(Rule(label, keyword, name, 4, 0.6))
        for v in versions:
            n = f"(?: licen[cs]e)?(?: version| ver)? {_number(v)}{_ending(v)}"
            out.append(Rule(f"{label}-{v}", keyword, name + n, 2, 0.95))
            out.append(Rule(f"{label}-{v}-or-later", keyword, f"{name}{n} or (?:\\(?at your option\\)? )?(?:any )?later(?: version)?", 1, 1.0))
            out.append(Rule(f"{label}-{v}-only", keyword, f"{name}{n} only", 1, 1.0))
    out += [Rule(label, keyword, regex, p, w) for label, keyword, regex, p, w in PLAIN + SENTENCES]
    for short, long in CLAUSES.items():
        label = "cc-" + short.replace(" ", "-")
        tail = "" if "nd" in short or "sa" in short else "(?! (?:sa|nc|nd) )"
        out.append(Rule(label, "cc by", f"cc {short}{tail}", 3, 0.8))
        out.append(Rule(label, "creative commons", f"creative commons {long}(?: licen[cs]e)?", 3, 0.8))
        for v in CC_VERSIONS:
            n = f" {_number(v)}{_ending(v)}"
            out.append(Rule(f"{label}-{v}", "cc by", f"cc {short}{n}", 2, 0.95))
            out.append(Rule(f"{label}-{v}", "creative commons", f"creative commons {long}(?: licen[cs]e)?{n}", 2, 0.95))
            out.append(Rule(f"{label}-{v}", "creativecommons org", f"creativecommons org licen[cs]es {short}{n}", 1, 1.0))
    return out
