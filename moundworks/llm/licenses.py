"""Operator 6: license scan by Aho-Corasick automata and a shunting-yard parser of licence expressions.

Two automata run over each whole text: one over its words (A-Z lower-cased, joined by one space) finds the notice
phrases, one over the text itself finds identifier tags. What follows a tag on its line is an expression of identifiers,
``and``, ``or``, ``with`` and brackets; it is turned into postfix form by the shunting-yard algorithm (``with`` binds
closest, then ``and``, then ``or``) and evaluated to labels and to a value of openness: ``or`` takes the larger, ``and``
the smaller, ``with`` raises its licence by a tenth. An expression that can't be parsed counts as unknown. A document's
score is the smallest value found, 0 where nothing was.

Defined cases: null text is empty, with no words and null places; overlapping and repeated phrases all count; repeated
rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases that the method adds: names of public licences and opening words of their texts. Fixed values.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "licensed under the apache license version 2 0": "apache-2.0", "apache software license": "apache",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "2 clause bsd": "bsd-2-clause", "3 clause bsd": "bsd-3-clause",
    "isc license": "isc", "permission to use copy modify and or distribute this software for any purpose": "isc",
    "zlib license": "zlib", "boost software license": "bsl-1.0", "python software foundation license": "psf", "artistic license": "artistic", "academic free license": "afl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "common development and distribution license": "cddl", "european union public licence": "eupl", "microsoft public license": "ms-pl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl", "gnu free documentation license": "gfdl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "creative commons": "cc", "creative commons attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd", "attribution noderivs": "cc-by-nd",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "cc zero": "cc0",
    "public domain": "public-domain", "this is free and unencumbered software released into the public domain": "unlicense", "open data commons": "odc", "open database license": "odbl", "sil open font license": "ofl",
    "proprietary and confidential": "proprietary", "unauthorized copying of this file": "proprietary", "no part of this publication may be reproduced": "reserved", "reproduction without permission is prohibited": "reserved",
}
#: The first also ends the usual longer tag.
TAGS = ("license-identifier:", "license-expression:")
#: Openness by the start of a label, the longest fitting first; what isn't here is unknown.
OPENNESS = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 1.0, "bsd": 1.0, "apache": 1.0, "isc": 1.0, "zlib": 1.0, "bsl-1.0": 1.0, "psf": 1.0, "0bsd": 1.0,
    "cc-by": 0.9, "odc": 0.9, "ofl": 0.9, "artistic": 0.8, "afl": 0.8, "ms-pl": 0.8, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "eupl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6, "odbl": 0.6, "cc": 0.6, "gfdl": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN = 0.5
#: Bytes of words: digits, lower-case letters and all beyond ASCII; capitals become small, the rest a space.
WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
IDENTIFIER = re.compile(r"[a-z0-9.+:-]+")
RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def openness(label: str) -> float:
    fits = [k for k in OPENNESS if label == k or label.startswith(f"{k}-")]
    return OPENNESS[max(fits, key=len)] if fits else UNKNOWN


def postfix(expression: str) -> list[str] | None:
    """Identifiers and operators in postfix order; None if it isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    wants = True  # an identifier or an opening bracket comes next
    for token in re.findall(r"[a-z0-9.+:-]+|[()]|\S", expression.lower()):
        if token in RANK:
            if wants:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            wants = True
        elif token == "(":
            if not wants:
                return None
            stack.append(token)
        elif token == ")":
            if wants:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif IDENTIFIER.fullmatch(token) and wants:
            out.append(token)
            wants = False
        else:
            return None
    if wants or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and openness of an expression."""
    order = postfix(expression)
    if order is None:
        return {"unknown"}, UNKNOWN
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token in RANK:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, min(1.0, a + 0.1)))
                continue
            small, large = sorted((left, right), key=len)
            large |= small  # the smaller into the larger: a long expression stays near linear
            stack.append((large, max(a, b) if token == "or" else min(a, b)))
        else:
            label = token.rstrip("+")
            stack.append(({label}, openness(label)))
    return stack.pop()


def leading_expression(line: str) -> str:
    """The longest start of a line, in tokens, that is an expression; the line's first token if none is.

    One pass by the grammar of ``postfix``: the start is an expression wherever an identifier or a closing bracket has
    just been read and no bracket is open. It ends at the first token that no expression can go on with.
    """
    tokens: list[str] = []
    whole = depth = 0
    wants = True
    for found in re.finditer(r"[^\s()]+|[()]", line):
        tokens.append(found.group())
        for token in re.findall(r"[a-z0-9.+:-]+|[()]|\S", tokens[-1].lower()):
            if token in RANK or token == ")":
                fits, wants = not wants, token in RANK
            else:
                fits, wants = wants and (token == "(" or IDENTIFIER.fullmatch(token) is not None), token == "("
            depth += (token == "(") - (token == ")")
            if not fits or depth < 0:
                return " ".join(tokens[: whole or 1])
        if not wants and depth == 0:
            whole = len(tokens)
    return " ".join(tokens[: whole or 1])


@cache
def automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        phrases.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(raw: bytes | None) -> tuple:
    phrases, tags = automata()
    words = (raw or b"").translate(WORDS).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, base, labels, values = [], set(), set(), []
    at = spaces = 0
    for end, (label, n, is_base) in phrases.iter(joined):
        spaces, at = spaces + joined.count(" ", at, end), end  # spaces before the phrase's closing one: its last word
        labels.add(label)
        values.append(openness(label))
        if is_base:
            base.add(label)
            places.append(spaces - n)
    text = (raw or b"").lower()
    if b"license-" in text:
        shown = text.decode("utf-8", "replace")
        for end, _ in tags.iter(shown):
            found, value = evaluate(leading_expression(shown[end + 1 : shown.find("\n", end) % (len(shown) + 1)]))
            labels |= found
            values.append(value)
    score = min(values) if values else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_table(docs: DataFrame) -> DataFrame:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = list(zip(*(scan(raw) for raw in as_bytes(batch, "text")), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
