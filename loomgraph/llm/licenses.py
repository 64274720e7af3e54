"""Licences that texts name: notice phrases, identifier tags, and the expressions that follow these.

Two Aho-Corasick automata read a text once each: one its words, for phrases; one its lower-cased characters, for tags.
What follows a tag is read by a shunting-yard parser, which turns ``and``, ``or``, ``with`` and brackets into postfix
order and evaluates it as it goes: both sides of ``and`` bind, one side of ``or`` may be chosen, ``with`` an exception
loosens what stands before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import prepared

#: The phrases of the base, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's own phrases, with their labels.
NOTICES = {
    "affero general public license": "agpl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "creative commons attribution": "cc",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Tags that an expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How identifiers begin, with their labels; the longest that fits counts, and others are OTHER.
FAMILIES = {"0bsd": "bsd", "agpl": "agpl", "apache": "apache", "bsd": "bsd", "bsl": "boost", "cc-": "cc", "cc0": "unlicense", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense"}
OTHER = "other"
#: How much a licence asks of who passes a text on, from 0 to 1; an exception halves it.
DEMANDS = {"unlicense": 0.05, "isc": 0.1, "mit": 0.1, "boost": 0.1, "bsd": 0.15, "apache": 0.2, "cc": 0.3, "epl": 0.5, "mpl": 0.5, "other": 0.5, "lgpl": 0.6, "gpl": 0.8, "agpl": 1.0}
EXCEPTION = 0.5

#: ASCII letters and digits and every byte of other characters make words; letters A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb" +")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:_-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def family(identifier: str) -> str:
    fits = [f for f in FAMILIES if identifier.startswith(f)]
    return FAMILIES[max(fits, key=len)] if fits else OTHER


def evaluate(text: str, at: int = 0) -> tuple[frozenset[str], float, str] | None:
    """The expression that ``text`` (lower case) begins with at ``at``: its labels, its demand, and its postfix form.

    The expression ends before what can't continue it: a word after an operand, a bracket that none opened, a line's
    end.  An operator that nothing follows is left out, open brackets are closed.  None if no identifier stands there.
    """
    values: list[tuple[frozenset[str], float]] = []
    postfix: list[str] = []
    waiting: list[str] = []
    brackets, operand_next = 0, True

    def apply() -> None:
        op, (more, other), (labels, demand) = waiting.pop(), values.pop(), values.pop()
        postfix.append(op)
        values.append((labels, demand * EXCEPTION) if op == "with" else (labels | more, max(demand, other) if op == "and" else min(demand, other)))

    while match := _TOKEN.match(text, at):
        bracket, word = match.groups()
        if operand_next and bracket == "(" and waiting[-1:] != ["with"]:
            waiting.append("(")
            brackets += 1
        elif operand_next and word and word not in _BINDS:
            postfix.append(word.rstrip(".:-_") or word)
            label = family(word)
            values.append((frozenset([label]), DEMANDS[label]))
            operand_next = False
        elif not operand_next and bracket == ")" and brackets:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
            brackets -= 1
        elif not operand_next and word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                apply()
            waiting.append(word)
            operand_next = True
        else:
            break
        at = match.end()
    while waiting:
        if waiting[-1] == "(" or operand_next:
            operand_next &= waiting.pop() == "("
        else:
            apply()
    return (*values[0], " ".join(postfix)) if values else None


def statements(text: str) -> tuple[int, list[tuple[int, str, bool, bool]], list[tuple[frozenset[str], float, str]]]:
    """Words of a text; the phrases in it as (first word, label, of the base, inside a longer one); the expressions after tags."""
    phrases, tags = _automata()
    words = b" " + _SPACES.sub(b" ", text.encode().translate(_WORDS)).strip(b" ") + b" "
    n = words.count(b" ") - 1 if len(words) > 2 else 0
    hits = sorted((end + 1 - size, -size, label, base) for end, (size, label, base) in phrases.iter(words.decode("latin-1")))
    found, before, counted, reach = [], 0, 0, 0
    for start, size, label, base in hits:
        before += words.count(b" ", counted, start)
        counted = start
        found.append((before, label, base, start - size <= reach))
        reach = max(reach, start - size)
    lower = text.translate(_LOWER)
    expressions = (evaluate(lower, end + 1) for end, _ in tags.iter(lower)) if ":" in text else ()
    return n, found, [e for e in expressions if e]


_LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions`` for each row of ``documents``.

    ``score`` is the largest demand of a phrase (one inside a longer phrase doesn't count) or an expression, 0 where
    there is none; ``expressions`` are in postfix form.  Null and empty texts have no words and no labels.  Repeated
    rows are scanned each for itself; a null ``doc_id`` is kept; other columns are ignored; an empty table gives an
    empty result.  Texts are never cut.
    """
    prepared(documents.sparkSession)

    def row(doc_id: int | None, text: str) -> tuple:
        n, found, expressions = statements(text)
        places = [word for word, _, base, _ in found if base]
        labels = {label for _, label, _, _ in found}.union(*(e[0] for e in expressions))
        demands = [DEMANDS[label] for _, label, _, inside in found if not inside] + [e[1] for e in expressions]
        joined = lambda x: ",".join(sorted(x))
        return doc_id, n, len(places), min(places, default=None), max(places, default=None), joined({label for _, label, base, _ in found if base}), joined(labels), max(demands, default=0.0), [e[2] for e in expressions]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        for batch in batches:
            rows = [row(k, t.as_py() or "") for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scanned, COLUMNS)
