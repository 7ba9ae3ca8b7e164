"""License scan: ordered signature rules.

Rules are regular expressions with a label, a priority and keywords: words that every
match holds, whatever separates them. A text is tried against a rule only if all the
rule's keywords are in it (one automaton finds all keywords in one pass). Of
overlapping detections a span that lies within the span of a detection of higher
priority is suppressed (equal priority: the longer span, then the earlier rule, wins).

Base phrases are found apart from the rules and are never suppressed: places where
the phrase's words stand consecutively, words being `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of
the text with A-Z in lower case.

Defined results: null text is the empty text (no words, no labels, score 0); rows of
repeated doc_ids are scanned each; an empty table gives no rows; further columns
are ignored; texts are never cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, lower_bytes, runs, slices, text_or_empty

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_WORD = np.ones(256, bool)
_WORD[0:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False

# The signatures: (label, priority, keywords, pattern); W stands for separators between words.
# Families first, then one rule for each version and each wording.
_PLAIN = [
    ("mit", 50, "mit license", r"\b(?:theW)?mitWlicense\b"),
    ("mit", 60, "permission hereby granted", r"permissionWisWherebyWgranted,?WfreeWofWcharge\b"),
    ("mit", 40, "under mit", r"\b(?:(?:licensed|released|distributed)W)?underW(?:theW)?mit\b"),
    ("mit-0", 70, "mit attribution", r"\bmitWnoWattribution\b"),
    ("isc", 50, "isc license", r"\biscWlicense\b"),
    ("isc", 60, "permission modify", r"permissionWtoWuse,WcopyW?,?WmodifyW?,?Wand(?:/or)?WdistributeWthisWsoftware"),
    ("bsd", 40, "bsd licen", r"\bbsd(?:Wstyle)?Wlicen[sc]e\b"),
    ("bsd", 55, "redistribution binary", r"redistributionWandWuseWinWsourceWandWbinaryWforms"),
    ("unlicense", 60, "unlicense", r"\b(?:theW)?unlicense\b"),
    ("unlicense", 60, "unencumbered domain", r"freeWandWunencumberedWsoftwareWreleasedWintoWtheWpublicWdomain"),
    ("public-domain", 30, "public domain", r"\bpublicWdomain\b"),
    ("zlib", 50, "zlib license", r"\bzlib(?:/libpng)?Wlicense\b"),
    ("wtfpl", 50, "wtfpl", r"\bwtfpl\b"),
    ("wtfpl", 60, "want public license", r"doWwhatWtheWf\w+WyouWwantWtoWpublicWlicense"),
    ("boost", 50, "boost license", r"\bboostWsoftwareWlicense\b"),
    ("artistic", 50, "artistic license", r"\bartisticWlicense\b"),
    ("eclipse", 50, "eclipse license", r"\beclipseWpublicWlicense\b"),
    ("mozilla", 50, "mozilla license", r"\bmozillaWpublicWlicense\b"),
    ("apache", 45, "apache licen", r"\bapacheWlicen[sc]e\b"),
    ("apache", 40, "apache licen", r"\bapacheWsoftwareWlicen[sc]e\b"),
    ("gnu", 20, "gnu licen", r"\bgnuW(?:\w+W)?(?:public|documentation)Wlicen[sc]e\b"),
    ("agpl", 55, "affero licen", r"\bafferoWgeneralWpublicWlicen[sc]e\b"),
    ("lgpl", 55, "lesser licen", r"\blesserWgeneralWpublicWlicen[sc]e\b"),
    ("lgpl", 55, "library licen", r"\blibraryWgeneralWpublicWlicen[sc]e\b"),
    ("gfdl", 55, "documentation licen", r"\bfreeWdocumentationWlicen[sc]e\b"),
    ("creative-commons", 20, "creative commons", r"\bcreativeWcommons\b"),
    ("cc0", 60, "cc0", r"\bcc0\b"),
    ("openrail", 50, "openrail", r"\b(?:bigscienceW|bigcodeW|creativemlW)?openrail(?:Wm|\+\+)?\b"),
    ("proprietary", 45, "proprietary confidential", r"\bproprietaryWandWconfidential\b"),
    ("proprietary", 40, "proprietary confidential", r"\bconfidentialWandWproprietary\b"),
    ("proprietary", 30, "reproduced", r"\b(?:may|must)WnotWbeWreproduced\b"),
    ("proprietary", 30, "without permission", r"\bwithoutW(?:priorW)?(?:writtenW)?permission\b"),
    ("copyright-notice", 25, "copyright", r"\bcopyrightW(?:\(c\)|©)?W?\d{4}\b"),
    ("copyright-notice", 25, "©", r"©W?\d{4}\b"),
    ("copyright-notice", 20, "copyright", r"\bcopyrightW(?:by|of|holder)\b"),
    ("license-header", 10, "licensed under", r"\blicensedWunderW(?:theW)?(?:termsWofW)?(?:theW)?[a-z0-9\-]+"),
    ("license-header", 10, "licen under", r"\b(?:this|the)W(?:work|text|file|software|document)WisWlicen[sc]edWunder\b"),
    ("license-header", 10, "licen", r"\bseeWlicen[sc]e(?:\.txt|\.md)?\b"),
    ("license-header", 10, "licen", r"\blicen[sc]e\.(?:txt|md|rst)\b"),
    ("spdx", 80, "spdx-license-identifier", r"\bspdx-license-identifier:\s*[a-z0-9.+\-]+"),
]
_VERSIONED = {  # label: (names, versions)
    "gpl": (["gnuWgeneralWpublicWlicen[sc]e", "generalWpublicWlicen[sc]e"], ["1", "2", "3"]),
    "gpl-short": (["gpl", "gnuWgpl"], ["1", "2", "3"]),
    "lgpl": (["lgpl", "gnuWlgpl"], ["2", "2.1", "3"]),
    "lesser-gpl": (["lesserWgeneralWpublicWlicen[sc]e"], ["2", "2.1", "3"]),
    "agpl": (["agpl", "gnuWagpl"], ["1", "3"]),
    "affero": (["afferoWgeneralWpublicWlicen[sc]e"], ["1", "3"]),
    "gfdl": (["gfdl"], ["1.1", "1.2", "1.3"]),
    "apache": (["apacheWlicen[sc]e", "apacheWsoftwareWlicen[sc]e", "apache"], ["1.0", "1.1", "2.0", "2"]),
    "mozilla": (["mozillaWpublicWlicen[sc]e"], ["1.0", "1.1", "2.0"]),
    "mpl": (["mpl"], ["1.0", "1.1", "2.0"]),
    "eclipse": (["eclipseWpublicWlicen[sc]e"], ["1.0", "2.0"]),
    "epl": (["epl"], ["1.0", "2.0"]),
    "cddl": (["cddl"], ["1.0", "1.1"]),
    "eupl": (["eupl"], ["1.0", "1.1", "1.2"]),
    "artistic": (["artisticWlicen[sc]e"], ["1.0", "2.0"]),
    "osl": (["openWsoftwareWlicen[sc]e"], ["1.0", "2.0", "2.1", "3.0"]),
    "afl": (["academicWfreeWlicen[sc]e"], ["2.0", "2.1", "3.0"]),
    "python": (["pythonWsoftwareWfoundationWlicen[sc]e"], ["2"]),
    "odbl": (["odbl", "openWdatabaseWlicen[sc]e"], ["1.0"]),
    "openrail-m": (["openrailWm"], ["1"]),
}
_CC_KINDS, _CC_VERSIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"], ["1.0", "2.0", "2.5", "3.0", "4.0"]
_CC_NAMES = {"by": "attribution", "by-sa": "attributionWshareWalike", "by-nc": "attributionWnonWcommercial", "by-nd": "attributionWnoWderiv(?:ative)?s", "by-nc-sa": "attributionWnonWcommercialWshareWalike", "by-nc-nd": "attributionWnonWcommercialWnoWderiv(?:ative)?s"}


@lru_cache(1)
def rules() -> list[tuple[str, int, str, regex.Pattern]]:
    """All rules in order: (label, priority, keywords, compiled pattern)."""
    found = list(_PLAIN)
    for label, (names, versions) in _VERSIONED.items():
        for name in names:
            keyword = " ".join(w for w in name.replace("licen[sc]e", "licen").split("W") if len(w) > 1)
            for v in versions:
                number = v.replace(".", r"\.") + (r"(?:\.0)?" if "." not in v else "")
                found.append((f"{label}-{v}", 70, keyword, rf"\b{name}\W{{0,3}}(?:v|ver\.?|version)?\W{{0,2}}{number}(?![\d.]*\d)"))
                found.append((f"{label}-{v}-or-later", 75, keyword, rf"\b{name}\W{{0,3}}(?:v|ver\.?|version)?\W{{0,2}}{number}(?:\+|,?WorW(?:anyW)?later)"))
    for kind in _CC_KINDS:
        short = kind.replace("-", "W")
        found.append((f"cc-{kind}", 50 + len(kind), "cc", rf"\bccW{short}\b"))
        found.append((f"cc-{kind}", 50 + len(kind), "creative attribution", rf"\bcreativeWcommonsW{_CC_NAMES[kind]}\b"))
        for v in _CC_VERSIONS:
            number = v.replace(".", r"\.")
            found.append((f"cc-{kind}-{v}", 70 + len(kind), "cc", rf"\bccW{short}W{number}\b"))
            found.append((f"cc-{kind}-{v}", 70 + len(kind), "creative attribution", rf"\bcreativeWcommonsW{_CC_NAMES[kind]}W(?:license|international|unported)?W?{number}\b"))
            found.append((f"cc-{kind}-{v}", 80 + len(kind), "creativecommons.org", rf"creativecommons\.org/licenses/{kind}/{number}"))
    return [(label, priority, keyword, regex.compile(regex.sub(r"(?<!\\)W", r"(?:\\W{1,4})", p))) for label, priority, keyword, p in found]


@lru_cache(1)
def _gate():
    """The automaton, which gives each keyword's bit, and the bits that each rule needs."""
    import ahocorasick

    words = sorted({w for _, _, keywords, _ in rules() for w in keywords.split()})
    bit = {w: 1 << i for i, w in enumerate(words)}
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, bit[w])
    found.make_automaton()
    return found, [sum(bit[w] for w in set(keywords.split())) for _, _, keywords, _ in rules()]


def detections(low: str) -> list[tuple[int, int, str, int]]:
    """Detections of a lower-case text after suppression: (start, end, label, priority)."""
    gate, needs = _gate()
    there = 0
    for _, b in gate.iter(low):
        there |= b
    if not there:
        return []
    active = [i for i, need in enumerate(needs) if need & there == need]
    table, hits = rules(), []
    for i in active:
        label, priority, _, pattern = table[i]
        hits += [(-priority, m.start() - m.end(), i, m.start(), m.end(), label) for m in pattern.finditer(low)]
    return suppressed(hits)


def suppressed(hits: list[tuple]) -> list[tuple[int, int, str, int]]:
    """Of (-priority, -length, rule, start, end, label) those that lie in no better one. The
    widest spans kept so far have rising starts and ends, so one of them tells: the last
    that starts no later."""
    kept, starts, ends = [], [], []
    for minus, _, _, a, b, label in sorted(hits):
        at = bisect_right(starts, a)
        if at and ends[at - 1] >= b:
            continue
        kept.append((a, b, label, -minus))
        first, last = bisect_left(starts, a), bisect_right(ends, b)
        starts[first : max(first, last)], ends[first : max(first, last)] = [a], [b]  # spans inside the new one go
    return sorted(kept)


def every_detection(low: str) -> list[tuple[int, int, str, int]]:
    """What detections() gives without its gate, for tests."""
    return suppressed([(-p, m.start() - m.end(), i, m.start(), m.end(), label) for i, (label, p, _, pattern) in enumerate(rules()) for m in pattern.finditer(low)])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,stop:long,label:string,priority:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = {k: (tuple(w.encode() for w in k.split()), v) for k, v in BASE.items()}
    for batch in slices(batches):
        texts = text_or_empty(batch.column("text"))
        data, at = joined_bytes(texts, " ")
        low = lower_bytes(data)
        start, end = runs(_WORD[low])
        n, first = len(at) - 1, np.searchsorted(start, at)
        raw, rows = low.tobytes(), []
        for k in range(n):
            words = int(first[k + 1] - first[k])
            text = raw[at[k] : at[k + 1] - 1].decode("utf-8", "replace")
            places, base = [], set()
            if b"cc" in (own := raw[at[k] : at[k + 1]]) or b"general" in own or b"reserved" in own:
                s, e = start[first[k] : first[k + 1]] - at[k], end[first[k] : first[k + 1]] - at[k]
                for parts, label in phrases.values():
                    hit = own.find(parts[0])
                    while hit >= 0:
                        i = int(np.searchsorted(s, hit))
                        if i < words and s[i] == hit and i + len(parts) <= words and all(own[s[i + j] : e[i + j]] == p for j, p in enumerate(parts)):
                            places.append(i)
                            base.add(label)
                        hit = own.find(parts[0], hit + 1)
            found = detections(text)
            labels = sorted(base | {x[2] for x in found})
            strength = max([60 if base else 0, *(x[3] for x in found)])
            rows.append((words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), min(1.0, strength / 100), [{"start": a, "stop": b, "label": x, "priority": p} for a, b, x, p in found]))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word counts, base places and labels, all labels, a score
    (the strongest rule's priority / 100) and the detections as character spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)
