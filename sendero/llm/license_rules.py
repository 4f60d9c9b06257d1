"""License signatures as ordered rules over normalised words.

A rule has a keyword (a word that must stand in the text before its pattern is
tried), a level (lower wins), a label, a confidence and a regular expression
over words joined by single blanks.  Rules come from three short lists of
fixed values: license families with their names and versions, phrases that
grant or refer to a license, and the identifiers of SPDX tags.
"""

from __future__ import annotations

from dataclasses import dataclass

# Levels, in order of priority.
TAG, VERSIONED, GRANT, NAME = range(4)
LEVELS = (TAG, VERSIONED, GRANT, NAME)
CONFIDENCE = {TAG: 1.0, VERSIONED: 0.95, GRANT: 0.9, NAME: 0.7}

# Label, keyword, names in words, versions.
FAMILIES = [
    ("gpl", "general", ["gnu general public license", "general public license"], ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", ["gnu gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], ["2", "2 1", "3", "3 0"]),
    ("lgpl", "library", ["gnu library general public license"], ["2", "2 0"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["1", "3", "3 0"]),
    ("gfdl", "documentation", ["gnu free documentation license"], ["1 1", "1 2", "1 3"]),
    ("apache", "apache", ["apache license", "apache software license"], ["1 0", "1 1", "2 0", "2"]),
    ("mit", "license", ["mit license", "expat license"], []),
    ("bsd", "bsd", ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "new bsd license", "simplified bsd license", "modified bsd license"], []),
    ("mpl", "mozilla", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1 0", "2 0"]),
    ("cddl", "distribution", ["common development and distribution license"], ["1 0", "1 1"]),
    ("eupl", "european", ["european union public license", "european union public licence"], ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", ["artistic license"], ["1 0", "2 0"]),
    ("boost", "boost", ["boost software license"], ["1 0"]),
    ("isc", "license", ["isc license"], []),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], []),
    ("unlicense", "unlicense", ["the unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["1", "2"]),
    ("ms-pl", "microsoft", ["microsoft public license"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], []),
    ("odbl", "database", ["open database license", "odc open database license"], ["1 0"]),
    ("ofl", "font", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("osl", "open", ["open software license"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic", ["academic free license"], ["1 2", "2 0", "2 1", "3 0"]),
    ("python", "python", ["python software foundation license"], ["2"]),
    ("php", "php", ["php license"], ["3 0", "3 01"]),
    ("ruby", "ruby", ["ruby license"], []),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("public-domain", "domain", ["public domain"], []),
    ("proprietary", "reserved", ["all rights reserved"], []),
]
# Creative Commons terms (in words) and versions.
CC_TERMS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CC_NAMES = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Words before a license name that grant it.
GRANTS = ["licensed under", "released under", "distributed under", "available under", "under the terms of", "published under"]
# Identifiers of SPDX tags by label.
SPDX = {
    "gpl": ["gpl 1 0", "gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 1 0", "agpl 3 0"],
    "apache": ["apache 1 0", "apache 1 1", "apache 2 0"], "mit": ["mit"], "bsd": ["bsd 2 clause", "bsd 3 clause", "0bsd"],
    "mpl": ["mpl 1 1", "mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"],
    "boost": ["bsl 1 0"], "artistic": ["artistic 1 0", "artistic 2 0"], "cc0": ["cc0 1 0"], "eupl": ["eupl 1 1", "eupl 1 2"],
}


@dataclass(frozen=True)
class Rule:
    level: int
    keyword: str
    label: str
    pattern: str

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.level]


def _rules_of(label: str, keyword: str, name: str, versions: list[str]) -> list[Rule]:
    rules = [Rule(NAME, keyword, label, name)]
    rules += [Rule(GRANT, keyword, label, f"{grant} (?:the |an? )?{name}(?: version [0-9]+(?: [0-9]+)?)?") for grant in GRANTS]
    rules += [Rule(VERSIONED, keyword, f"{label}-{v.replace(' ', '.')}", f"{name} (?:version |v)?{v}(?! [0-9])") for v in versions]
    return rules


def rules() -> list[Rule]:
    """All rules, in order: by level, then as listed."""
    out = [r for label, keyword, names, versions in FAMILIES for name in names for r in _rules_of(label, keyword, name, versions)]
    for terms in CC_TERMS:
        label = "cc-" + terms.replace(" ", "-")
        spelled = " ".join(CC_NAMES[t] for t in terms.split())
        end = "(?! (?:sa|nd|nc|sharealike|noderivatives|noncommercial) )"
        for keyword, name in (("cc", f"cc {terms}{end}"), ("creative", f"creative commons {spelled}{end}")):
            out += _rules_of(label, keyword, name, CC_VERSIONS)
    for label, tags in SPDX.items():
        out += [Rule(TAG, "spdx", label, f"spdx license identifier {tag}(?: only| or later)?") for tag in tags]
    return sorted(dict.fromkeys(out), key=lambda r: r.level)
