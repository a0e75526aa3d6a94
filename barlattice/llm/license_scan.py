"""License scan with ordered signature rules.

A text is brought to its lower-case words, joined by one blank, and rules are regexes over that form. A rule runs only if
its keyword stands in the text. Detections are resolved by priority: those of a higher one come first, and a detection whose
interval lies within a kept one is suppressed (within a priority the longer interval wins, then the smaller label).
Rules come from families (a label and how its name is written) and phrasings (a pattern around the name, its priority and
weight); four base rules mark the phrases of the contract and are reported whether or not they are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from barlattice.llm.common import LOWER, UPPER, table
from barlattice.llm.textbytes import pieces

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str  # literals parted by |, one of which any match holds or stands beside
    priority: int  # smaller is stronger
    weight: float
    base: bool = False


BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

_V = r"(?: (?:version|v))? ?"
# label, SPDX words, how the name is written, keyword that any of its rules needs
FAMILIES = (
    ("agpl-3.0", "agpl 3 0", rf"(?:gnu )?(?:affero general public license|agpl){_V}(?:3(?: 0)?)?", "agpl|affero"),
    ("gpl-1.0", "gpl 1 0", rf"(?:gnu )?(?:general public license|gpl){_V}1(?: 0)?", "gpl|general public"),
    ("gpl-2.0", "gpl 2 0", rf"(?:gnu )?(?:general public license|gpl){_V}2(?: 0)?", "gpl|general public"),
    ("gpl-3.0", "gpl 3 0", rf"(?:gnu )?(?:general public license|gpl){_V}3(?: 0)?", "gpl|general public"),
    ("lgpl-2.0", "lgpl 2 0", rf"(?:gnu )?(?:library general public license|lgpl){_V}2(?: 0)?", "lgpl|library general"),
    ("lgpl-2.1", "lgpl 2 1", rf"(?:gnu )?(?:lesser general public license|lgpl){_V}2 1", "lgpl|lesser general"),
    ("lgpl-3.0", "lgpl 3 0", rf"(?:gnu )?(?:lesser general public license|lgpl){_V}3(?: 0)?", "lgpl|lesser general"),
    ("gfdl-1.2", "gfdl 1 2", rf"(?:gnu )?(?:free documentation license|gfdl|fdl){_V}1 2", "fdl|free documentation"),
    ("gfdl-1.3", "gfdl 1 3", rf"(?:gnu )?(?:free documentation license|gfdl|fdl){_V}1 3", "fdl|free documentation"),
    ("apache-1.0", "apache 1 0", rf"apache(?: software)?(?: license)?{_V}1 0", "apache"),
    ("apache-1.1", "apache 1 1", rf"apache(?: software)?(?: license)?{_V}1 1", "apache"),
    ("apache-2.0", "apache 2 0", rf"apache(?: software)?(?: license)?{_V}2(?: 0)?", "apache"),
    ("mit", "mit", r"(?:the )?mit license", "mit license"),
    ("x11", "x11", r"x11 license", "x11"),
    ("isc", "isc", r"isc license", "isc license"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:simplified |freebsd |2 clause |two clause )bsd license|bsd 2 clause(?: license)?", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:new |modified |revised |3 clause |three clause )bsd license|bsd 3 clause(?: license)?", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:original |old |4 clause |four clause )bsd license|bsd 4 clause(?: license)?", "bsd"),
    ("0bsd", "0bsd", r"zero clause bsd(?: license)?|0bsd", "bsd"),
    ("mpl-1.0", "mpl 1 0", rf"(?:mozilla public license|mpl){_V}1 0", "mpl|mozilla"),
    ("mpl-1.1", "mpl 1 1", rf"(?:mozilla public license|mpl){_V}1 1", "mpl|mozilla"),
    ("mpl-2.0", "mpl 2 0", rf"(?:mozilla public license|mpl){_V}2(?: 0)?", "mpl|mozilla"),
    ("epl-1.0", "epl 1 0", rf"(?:eclipse public license|epl){_V}1 0", "epl|eclipse"),
    ("epl-2.0", "epl 2 0", rf"(?:eclipse public license|epl){_V}2(?: 0)?", "epl|eclipse"),
    ("cpl-1.0", "cpl 1 0", rf"common public license{_V}1 0", "common public license"),
    ("cddl-1.0", "cddl 1 0", rf"(?:common development and distribution license|cddl){_V}1 0", "cddl|common development"),
    ("cddl-1.1", "cddl 1 1", rf"(?:common development and distribution license|cddl){_V}1 1", "cddl|common development"),
    ("eupl-1.1", "eupl 1 1", rf"(?:european union public licen[cs]e|eupl){_V}1 1", "eupl|european union"),
    ("eupl-1.2", "eupl 1 2", rf"(?:european union public licen[cs]e|eupl){_V}1 2", "eupl|european union"),
    ("artistic-1.0", "artistic 1 0", rf"artistic license{_V}1 0", "artistic license"),
    ("artistic-2.0", "artistic 2 0", rf"artistic license{_V}2(?: 0)?", "artistic license"),
    ("afl-3.0", "afl 3 0", rf"academic free license{_V}3(?: 0)?", "academic free license"),
    ("osl-3.0", "osl 3 0", rf"open software license{_V}3(?: 0)?", "open software license"),
    ("bsl-1.0", "bsl 1 0", rf"boost software license{_V}(?:1 0)?", "boost software license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", r"libpng license", "libpng"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("psf-2.0", "psf 2 0", rf"(?:psf|python software foundation) license(?: agreement)?{_V}(?:2(?: 0)?)?", "psf|python software"),
    ("ofl-1.1", "ofl 1 1", rf"(?:sil )?open font license{_V}(?:1 1)?", "open font license"),
    ("ms-pl", "ms pl", r"microsoft public license|ms pl", "ms pl|microsoft"),
    ("ms-rl", "ms rl", r"microsoft reciprocal license|ms rl", "ms rl|microsoft"),
    ("odbl-1.0", "odbl 1 0", r"open (?:data commons open )?database license|odbl", "odbl|database license"),
    ("busl-1.1", "busl 1 1", r"business source license(?: 1 1)?", "business source license"),
    ("sspl-1.0", "sspl 1 0", r"server side public license", "server side public license"),
    ("public-domain", "public domain", r"public domain", "public domain"),
    ("cc0-1.0", "cc0 1 0", r"(?:cc0|cc zero)(?: 1 0)?", "cc"),
    *(
        (f"cc-{kind.replace(' ', '-')}-{v}", f"cc {kind} {v.replace('.', ' ')}", rf"(?:cc|creative commons) {words} {v.replace('.', ' ')}", "cc|creative commons")
        for kind, words in (
            ("by", "(?:by|attribution)"), ("by sa", "(?:by sa|attribution share ?alike)"), ("by nc", "(?:by nc|attribution non ?commercial)"),
            ("by nd", "(?:by nd|attribution no ?deriv(?:ative)?s)"), ("by nc sa", "(?:by nc sa|attribution non ?commercial share ?alike)"),
            ("by nc nd", "(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
    ),
)
# phrasing: pattern around the name, priority, weight, further keyword
PHRASINGS = (
    ("spdx license identifier {spdx}(?: only| or later)?", 0, 1.0, "spdx license identifier"),
    ("(?:dual )?(?:licensed|licenced|released|distributed|published|available|provided|redistributed) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: license)?(?: only| or later| or any later version)?", 1, 0.95, " under "),
    ("(?:license|licence)(?: is| type| name)? (?:the )?(?:{name})", 2, 0.85, "licen"),
    ("(?:{name})(?: only| or later| or any later version)?", 3, 0.7, ""),
    ("copyright \\d{{4}}(?: \\d{{4}})?(?: \\w+){{1,6}} (?:{name})", 3, 0.75, "copyright"),
)


def rules() -> tuple[Rule, ...]:
    """All rules in order: by priority, base rules last."""
    made = [
        Rule(label, pattern.format(name=name, spdx=spdx), keyword if not gate else gate, priority, weight)
        for pattern, priority, weight, gate in PHRASINGS for label, spdx, name, keyword in FAMILIES
    ]
    made.sort(key=lambda r: r.priority)
    return (*made, *(Rule(label, phrase, phrase, 4, 0.5, base=True) for label, phrase in BASE))


class Scanner:
    def __init__(self, given: tuple[Rule, ...]):
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in given:
            self.by_keyword.setdefault(r.keyword, []).append((r, re.compile(f"(?<![^ ])(?:{r.pattern})(?![^ ])")))
        # What any rule's match holds; most texts have none of them and end here.
        self.any = ("licen", "gpl", "cc", "spdx", "public domain", "mpl", "epl", "fdl", "cddl", "eupl", "apache", "bsd", "wtfpl", "ms pl", "ms rl", "odbl", "creative commons")

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(first word, last word, rule) of all matches of all rules whose keyword is present."""
        found = []
        if not any(k in text for k in self.any):
            return found
        starts = None
        for keyword, group in self.by_keyword.items():
            if not any(k in text for k in keyword.split("|")):
                continue
            for rule, pattern in group:
                for m in pattern.finditer(text):
                    if starts is None:
                        starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
                    found.append((bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1, rule))
        return found


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no kept one contains, strongest priority first."""
    kept: list[tuple[int, int, Rule]] = []
    for priority in sorted({f[2].priority for f in found}):
        level = sorted((f for f in found if f[2].priority == priority), key=lambda f: (f[0], -f[1], f[2].label))
        begin, reach = [], []  # of what stronger priorities keep: starts, and the furthest end up to each
        for s, e, _ in sorted(kept, key=lambda f: f[0]):
            begin.append(s)
            reach.append(max(e, reach[-1] if reach else e))
        furthest = -1
        for s, e, rule in level:
            at = bisect_right(begin, s) - 1
            if e <= furthest or (at >= 0 and reach[at] >= e):
                continue
            furthest = e
            kept.append((s, e, rule))
    return kept


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, n_detections long, n_suppressed long")


def scan(docs: DataFrame, given: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, base places, labels, score (weight of the strongest kept detection, else 0).

    Null or empty text has no words and no label. Ids may be null or repeat; rows are scanned one by one. Whole texts are
    read, other columns are ignored, an empty table gives no rows.
    """
    given = rules() if given is None else given

    def run(batches):
        scanner = Scanner(given)
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").translate(_FOLD))
                found = scanner.detections(" ".join(words))
                kept = resolve(found)
                base = [f for f in found if f[2].base]
                base_labels = {f[2].label for f in base}
                labels = base_labels | {f[2].label for f in kept}
                rows.append((
                    len(words), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(labels)), max((f[2].weight for f in kept), default=0.0), len(kept), len(found) - len(kept)))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, _SCHEMA)


def op2_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
