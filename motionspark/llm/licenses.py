"""Operator 8: license scans by ordered signature rules.

Rules are regular expressions over the text with A-Z lowered, each with a label and a priority. They are made
from tables of license families (names, versions, identifiers, addresses); a space in them stands for a run of
white space. The character strings that every match of a rule holds are read off its pattern, and a document is
scanned by just those rules all of whose strings it holds, so nothing that matches is left out. Of overlapping detections the one of the higher priority stays: a detection
contained in another of the same or a higher priority is dropped (equal spans: the first rule's stays).

Base labels come from phrases of consecutive words and always stay.

Defined cases: null text counts as empty; empty and clean texts give zero counts, null places, empty labels
and score 0; repeated rows are each scanned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches
from .words import BYTE, Slice, Words, hash_word, hashes, slices, words

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lowered
WORD = (BYTE >= 128) | ((BYTE >= 48) & (BYTE <= 57)) | ((BYTE >= 97) & (BYTE <= 122)) | ((BYTE >= 65) & (BYTE <= 90))
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

# License families. Label: (name pattern, versions; "" where a license has none).
FAMILIES = {
    "apache": (r"apache(?: software)?(?: license)?", ("1.0", "1.1", "2.0")),
    "mit": (r"mit", ("",)),
    "mit-0": (r"mit no attribution", ("",)),
    "gpl": (r"gnu general public licen[sc]e|gnu gpl", ("1.0", "2.0", "3.0")),
    "lgpl": (r"gnu (?:lesser|library) general public licen[sc]e|gnu lgpl", ("2.0", "2.1", "3.0")),
    "agpl": (r"gnu affero general public licen[sc]e|gnu agpl", ("1.0", "3.0")),
    "gfdl": (r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3")),
    "mpl": (r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    "epl": (r"eclipse public licen[sc]e", ("1.0", "2.0")),
    "edl": (r"eclipse distribution licen[sc]e", ("1.0",)),
    "cddl": (r"common development and distribution licen[sc]e", ("1.0", "1.1")),
    "cpl": (r"common public licen[sc]e", ("1.0",)),
    "ipl": (r"ibm public licen[sc]e", ("1.0",)),
    "eupl": (r"european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    "osl": (r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    "afl": (r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (r"artistic", ("1.0", "2.0")),
    "bsl": (r"boost software", ("1.0",)),
    "busl": (r"business source", ("1.0", "1.1")),
    "sspl": (r"server side public", ("1.0",)),
    "elastic": (r"elastic", ("1.0", "2.0")),
    "zlib": (r"zlib(?:/libpng)?", ("",)),
    "libpng": (r"libpng", ("",)),
    "isc": (r"isc", ("",)),
    "unlicense": (r"(?:the )?unlicense", ("",)),
    "wtfpl": (r"wtfpl", ("", "2.0")),
    "psf": (r"python(?: software foundation)?", ("2.0",)),
    "php": (r"php", ("3.0", "3.01")),
    "ruby": (r"ruby", ("",)),
    "perl": (r"perl", ("",)),
    "postgresql": (r"postgresql", ("",)),
    "openssl": (r"openssl", ("",)),
    "ncsa": (r"(?:university of illinois/)?ncsa(?: open source)?", ("",)),
    "w3c": (r"w3c(?: software)?", ("",)),
    "ms-pl": (r"microsoft public", ("",)),
    "ms-rl": (r"microsoft reciprocal", ("",)),
    "ofl": (r"(?:sil )?open font", ("1.0", "1.1")),
    "odbl": (r"open (?:data(?:base)?|data commons open database)", ("1.0",)),
    "odc-by": (r"open data commons attribution", ("1.0",)),
    "pddl": (r"public domain dedication and", ("1.0",)),
    "openrail": (r"openrail(?:-m)?", ("",)),
    "bsd-2-clause": (r"(?:2|two)-clause bsd|simplified bsd|freebsd", ("",)),
    "bsd-3-clause": (r"(?:3|three)-clause bsd|(?:new|modified|revised) bsd", ("",)),
    "bsd-4-clause": (r"(?:4|four)-clause bsd|original bsd", ("",)),
    "bsd": (r"bsd", ("",)),
    "ecl": (r"educational community", ("1.0", "2.0")),
    "upl": (r"universal permissive", ("1.0",)),
    "vim": (r"vim", ("",)),
    "sleepycat": (r"sleepycat", ("",)),
    "unicode": (r"unicode", ("3.0",)),
    "cecill": (r"cecill", ("1.0", "2.0", "2.1")),
    "nasa": (r"nasa open source(?: agreement)?", ("1.3",)),
    "qpl": (r"q public", ("1.0",)),
    "lppl": (r"latex project public", ("1.0", "1.1", "1.2", "1.3")),
}
#: Names in addresses of license texts.
HOSTS = {"apache": r"apache\.org/licenses/license-", "gpl": r"gnu\.org/licenses/gpl-", "lgpl": r"gnu\.org/licenses/lgpl-", "agpl": r"gnu\.org/licenses/agpl-", "gfdl": r"gnu\.org/licenses/fdl-", "mpl": r"mozilla\.org/mpl/", "epl": r"eclipse\.org/(?:legal/epl-|org/documents/epl-)"}
#: Creative Commons: label part, words.
CC_KINDS = {"by": "attribution", "by-sa": "attribution[- ]share[- ]?alike", "by-nc": "attribution[- ]non-?commercial", "by-nd": "attribution[- ]no[- ]?deriv(?:ative|ative work)s?", "by-nc-sa": "attribution[- ]non-?commercial[- ]share[- ]?alike", "by-nc-nd": "attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative|ative work)s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Rules of their own: label, pattern, priority.
OTHERS = (
    ("spdx-tag", r"spdx-license-identifier:\s*[a-z0-9.+-]+", 10),
    ("public-domain", r"\b(?:in(?:to)? the|dedicated to the) public domain\b", 30),
    ("cc0-1.0", r"\bcc0(?:[- ]1\.0)?\b", 60),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", 70),
    ("reserved", r"\ball rights reserved\b", 20),
    ("reserved", r"\balle rechte vorbehalten\b", 20),
    ("reserved", r"\btous droits r.serv.s\b", 20),
    ("reserved", r"\btodos los derechos reservados\b", 20),
    ("copyright", r"\bcopyright (?:\(c\) |© )?(?:[0-9]{4}(?:[-, ]+[0-9]{4})*)", 15),
    ("proprietary", r"\bproprietary (?:and confidential|license|software)\b", 25),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", 65),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 65),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", 55),
    ("apache-2.0", r"licensed under the apache license, version 2\.0", 80),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    priority: int


def _version(v: str) -> str:
    """1.0 is also written 1."""
    return re.escape(v[:-2]) + r"(?:\.0)?" if v.endswith(".0") else re.escape(v)


def _spaced(pattern: str) -> str:
    """A space of the tables is a run of white space, a line's end included."""
    return pattern.replace("[- ]", r"(?:-|\s+)").replace("[-, ]", r"[-,\s]").replace(" ?", r"\s*").replace(" ", r"\s+")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, those of the highest priority first."""
    out: list[Rule] = []
    add = lambda label, pattern, priority: out.append(Rule(label, re.compile(_spaced(pattern)), priority))
    for family, (name, versions) in FAMILIES.items():
        # a name that holds no word for a license needs one after it: "python 3" is none
        tail = r"(?: public)?(?: licen[sc]es?)?" if "licen" in name else r"(?: public)? licen[sc]es?"
        for v in versions:
            label = f"{family}-{v}" if v else family
            if v:
                add(label, rf"\b(?:{name}){tail},? ?(?:\(?[a-z0-9-]+\)?,? )?(?:version |v\.? ?)?{_version(v)}(?![0-9]|\.[0-9])", 60)
                # where the family is called as a program is, "php 3.0" is that program; the license is php-3.0
                joint = "-" if "licen" not in name and re.fullmatch(name, family) else "[- ]?"
                add(label, rf"\b{re.escape(family)}{joint}v?{_version(v)}(?:-only|-or-later|\+)?(?![0-9]|\.[0-9])", 70)
                add(label, rf"spdx-license-identifier:\s*{re.escape(family)}-{re.escape(v)}(?:-only|-or-later|\+)?(?![0-9.])", 90)
                if family in HOSTS:
                    add(label, HOSTS[family] + _version(v) + r"(?![0-9])", 80)
                if family in ("gpl", "lgpl", "agpl"):
                    add(label, rf"\b{family}v{_version(v)}\b", 70)
            else:
                add(label, rf"\b(?:{name})[- ](?:style )?(?:public )?licen[sc]e\b", 50)
                add(label, rf"\blicen[sc]ed? (?:under )?(?:the )?(?:terms of )?(?:the )?{re.escape(family)}\b", 55)
                add(label, rf"spdx-license-identifier:\s*{re.escape(family)}(?![a-z0-9.-])", 90)
        if versions != ("",):
            add(family, rf"\b(?:{name}){tail}\b", 40)
    for kind, phrase in CC_KINDS.items():
        for v in CC_VERSIONS:
            label = f"cc-{kind}-{v}"
            add(label, rf"\bcc[- ]{kind}[- ]{re.escape(v)}(?![0-9])", 70)
            add(label, rf"\bcreative commons {phrase} {_version(v)}(?![0-9])", 70)
            add(label, rf"creativecommons\.org/licenses/{kind}/{re.escape(v)}", 80)
        add(f"cc-{kind}", rf"\bcc[- ]{kind}\b(?!-)", 40)
        add(f"cc-{kind}", rf"\bcreative commons {phrase}\b", 45)
    for label, pattern, priority in OTHERS:
        add(label, pattern, priority)
    return tuple(sorted(out, key=lambda r: -r.priority))


#: A string in lowered UTF-8, and whether it stands at a word's start.
Need = tuple[bytes, bool]


def needs(pattern: str) -> list[frozenset[Need]]:
    """What every match of a pattern holds: at least one string of each set."""

    def walk(tree, word: bool) -> list[frozenset[Need]]:
        out, run = [], ""
        starts = word
        for op, arg in [*tree, (None, None)]:
            if op is C.LITERAL:
                run, starts, word = run + chr(arg), starts if run else word, False
                continue
            if len(run) > 1:
                out.append(frozenset({(run.encode(), starts)}))
            run = ""
            if op is C.SUBPATTERN:
                out += walk(arg[3], word)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0]:
                out += walk(arg[2], word)
            elif op is C.BRANCH:
                ways = [walk(x, word) for x in arg[1]]
                if all(ways):  # a branch without a string asks for nothing
                    out.append(frozenset().union(*(max(w, key=lambda x: min(len(n) for n, _ in x)) for w in ways)))
            word = op is C.AT and arg is C.AT_BOUNDARY
        return out

    return walk(_parser.parse(pattern), False)


@cache
def _by_need() -> dict[Need, tuple[tuple[int, tuple[frozenset[Need], ...]], ...]]:
    """Rules by the strings of their longest need, each with its other needs."""
    table: dict[Need, list] = {}
    for i, rule in enumerate(rules()):
        first, *others = sorted(needs(rule.pattern.pattern), key=lambda x: -min(len(n) for n, _ in x))
        for need in first:
            table.setdefault(need, []).append((i, tuple(others)))
    return {k: tuple(v) for k, v in table.items()}


_IN_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_")


def _holds(text: bytes, need: Need) -> bool:
    string, starts = need
    at = text.find(string)
    while starts and at > 0 and text[at - 1] in _IN_WORD:
        at = text.find(string, at + 1)
    return at >= 0


def candidates(text: bytes) -> list[int]:
    """The rules that may match a lowered text: it holds all their strings."""
    seen: dict[Need, bool] = {}

    def met(need: Need) -> bool:
        if need not in seen:
            seen[need] = _holds(text, need)
        return seen[need]

    return sorted({i for need, own in _by_need().items() if met(need) for i, others in own if all(any(map(met, x)) for x in others)})


def detections(text: str, numbers: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the rules' matches in a lowered text, without those contained in one of the same or a higher priority."""
    found = [(m.start(), m.end(), n) for n in numbers for m in rules()[n].pattern.finditer(text)]
    priority = lambda n: rules()[n].priority
    # the longest first at each start: what could contain a detection comes before it
    found.sort(key=lambda d: (d[0], -d[1], -priority(d[2]), d[2]))
    kept: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int, int]] = []
    for d in found:
        open_ = [o for o in open_ if o[1] > d[0]]
        if not any(o[1] >= d[1] and priority(o[2]) >= priority(d[2]) for o in open_):
            kept.append(d)
        open_.append(d)
    return kept


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scan(part: Slice) -> list[dict]:
    """The result of each row of a slice."""
    found = words(part, WORD)
    h = hashes(part, found)
    places: list[list[tuple[int, str]]] = [[] for _ in range(part.rows)]
    for label, phrase in PHRASES.items():
        n = len(phrase)
        if len(h) < n:
            continue
        at = np.flatnonzero(h[: len(h) - n + 1] == np.uint64(hash_word(phrase[0])))
        for k in range(1, n):
            at = at[(h[at + k] == np.uint64(hash_word(phrase[k]))) & (found.row[at + k] == found.row[at])]
        for i in at.tolist():
            places[found.row[i]].append((i - int(found.first[found.row[i]]), label))
    own: dict[int, list[tuple[int, int, int]]] = {}
    for row in range(part.rows):
        text = part.data[part.offsets[row] : part.offsets[row + 1]].tobytes().translate(_LOWER)
        if numbers := candidates(text):
            own[row] = detections(text.decode("utf-8", "replace"), numbers)
    out = []
    for row, n in enumerate(found.per_row.tolist()):
        base, more = places[row], own.get(row, [])
        starts = [s for s, _ in base]
        labels = {x for _, x in base}
        miss = 1.0
        for _, _, n_rule in more:
            miss *= 1 - rules()[n_rule].priority / 100
        score = max(0.5 * bool(base), 1 - miss)
        out.append({"n_words": n, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {rules()[r].label for _, _, r in more})), "score": round(score, 6), "spans": [{"start": s, "end": e, "label": rules()[r].label} for s, e, r in more]})
    return out


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts and labels, and ``spans``, the kept detections in code points of the lowered text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for part in slices(batch.column("text")):
                rows += [{"doc_id": ids[part.first + i]} | r for i, r in enumerate(scan(part))]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {SCANNED}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


__all__ = ["Words", "detections", "op8_license_scan", "rules", "scan", "scan_licenses"]
