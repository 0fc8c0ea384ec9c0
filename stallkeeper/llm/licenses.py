"""Licence scans: one Aho-Corasick pass finds tags and notice phrases, a shunting-yard parser reads licence expressions.

Texts are brought to words of [0-9a-z] and non-ASCII characters, lower-cased, one space apart, so a phrase is found across
any punctuation and line break, and only at word borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stallkeeper.llm import words as W

#: Phrases that the result counts by place, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of common licences: label and weight of the evidence.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.8),
    "mit license": ("mit", 0.6),
    "licensed under the apache license": ("apache-2.0", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "mozilla public license": ("mpl-2.0", 0.7),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "creative commons zero": ("cc0-1.0", 0.7),
    "cc0 1 0": ("cc0-1.0", 0.7),
    "public domain": ("public-domain", 0.4),
    "unauthorized copying": ("proprietary", 0.6),
    "no part of this publication may be reproduced": ("proprietary", 0.8),
}
#: Words that announce a licence expression in the rest of the line.
TAGS = ("spdx license identifier", "license expression")
BASE_WEIGHT, TAG_WEIGHT = 0.5, 0.95
#: How much a licence asks for, by the start of its identifier; the longest start counts.
RESTRICTIONS = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "cc-by": 0, "0bsd": 0,
    "mpl": 1, "lgpl": 1, "epl": 1, "cddl": 1, "cc-by-sa": 1,
    "gpl": 2, "agpl": 2, "cc-by-nc": 3, "cc-by-nd": 3, "licenseref-proprietary": 3,
}
NAMES = ("permissive", "weak copyleft", "copyleft", "restricted", "unknown")
UNKNOWN = 4
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_EXPRESSION = re.compile(r"(?:SPDX-License-Identifier|License-Expression)\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if W.ALNUM[b] else 32 for b in range(256))


def parse(text: str) -> list[str] | None:
    """Identifiers and operators in postfix order; None if `text` does not start with a whole expression.

    WITH binds tighter than AND, AND tighter than OR; operators of one kind are read from the left. Words that cannot
    continue the expression end it (a comment's closing mark, a sentence); an open parenthesis makes it invalid.
    """
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    while m := _TOKEN.match(text, at):
        token, word = m[1], m[1].lower()
        if token == "(" and operand:
            stack.append(token)
        elif token == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in PRECEDENCE and not operand:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif operand and token not in "()" and word not in PRECEDENCE:
            out.append(word.rstrip(".:"))
            operand = False
        else:
            break
        at = m.end()
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def restriction(licence: str) -> int:
    known = [k for k in RESTRICTIONS if licence.startswith(k)]
    return RESTRICTIONS[max(known, key=len)] if known else UNKNOWN


def evaluate(postfix: list[str]) -> int:
    """Least restriction that a user can choose: OR takes the smaller, AND the larger, an exception eases copyleft by one."""
    stack: list[int] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(restriction(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(min(left, right) if token == "or" else max(left, right) if token == "and" else max(0, left - 1) if left in (1, 2) else left)
    return stack[0]


def identifiers(postfix: list[str]) -> list[str]:
    """Licences of an expression, without its exceptions."""
    stack: list[list[str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append([token])
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left + right)
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str, float]]] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    for phrase in TAGS:
        found.setdefault(phrase, []).append(("tag", "", 0.0))
    made = ahocorasick.Automaton()
    for phrase, what in found.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, what))
    made.make_automaton()
    return made


def scan(text: bytes, phrases: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, restriction) of one text in UTF-8."""
    words = text.translate(_WORDS).split()
    plain = b" ".join([b"", *words, b""])
    places: list[int] = []
    base: set[str] = set()
    evidence: dict[str, float] = {}
    tagged, spaces = False, None
    for end, (length, what) in phrases.iter(plain.decode("latin-1")):
        for kind, label, weight in what:
            if kind == "tag":
                tagged = True
                continue
            evidence[label] = max(weight, evidence.get(label, 0.0))
            if kind == "base":
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                base.add(label)
                places.append(int(np.searchsorted(spaces, end - length + 1)))
    expressions, least = [], None
    if tagged:
        for m in _EXPRESSION.finditer(text.decode("utf-8", "replace")):
            if postfix := parse(m[1]):
                expressions.append(" ".join(postfix))
                least = min(evaluate(postfix), UNKNOWN if least is None else least)
                evidence |= {licence.replace(",", ""): TAG_WEIGHT for licence in identifiers(postfix)}
    score = 1.0 - float(np.prod([1.0 - w for w in evidence.values()]))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(evidence)), round(score, 9), expressions, None if least is None else NAMES[least])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, restriction string"
_TYPES = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("restriction", pa.string())])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...); other columns are not read.

    Null and empty texts have no words, no places (first_word and last_word null), empty labels and score 0. `score` is
    the chance that some evidence holds: one minus the product of (1 - weight) over the labels. `expressions` are the
    licence expressions behind identifier tags in postfix order; `restriction` is the least of what they ask for, null
    without one. Repeated rows give repeated results. No shuffle; a task holds one text at a time beside its Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                raw = data.tobytes()
                found = [scan(raw[a:b], phrases) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), _TYPES.types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=_TYPES)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
