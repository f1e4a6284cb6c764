"""Licence statements in texts: phrases and identifier tags by Aho-Corasick, tags parsed as expressions.

Phrases are runs of words, so punctuation, case of A-Z and line breaks between them do not
matter.  Behind a tag such as ``SPDX-License-Identifier:`` stands an expression of licence
identifiers joined by ``and``, ``or`` and ``with``, which a shunting-yard parser evaluates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.text import slices, utf8_column

# The phrases and labels every scan must know.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Phrase, label and how surely the phrase alone states that licence.
PHRASES = [
    ("apache license", "apache", 0.7),
    ("apache license version 2 0", "apache-2.0", 0.95),
    ("apache 2 0 license", "apache-2.0", 0.9),
    ("mit license", "mit", 0.8),
    ("released under the mit license", "mit", 0.95),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("bsd license", "bsd", 0.8),
    ("2 clause bsd", "bsd-2-clause", 0.9),
    ("bsd 2 clause", "bsd-2-clause", 0.9),
    ("3 clause bsd", "bsd-3-clause", 0.9),
    ("bsd 3 clause", "bsd-3-clause", 0.9),
    ("isc license", "isc", 0.8),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.9),
    ("mozilla public license", "mpl", 0.8),
    ("mozilla public license version 2 0", "mpl-2.0", 0.95),
    ("eclipse public license", "epl", 0.8),
    ("general public license version 2", "gpl-2.0", 0.95),
    ("general public license version 3", "gpl-3.0", 0.95),
    ("lesser general public license", "lgpl", 0.9),
    ("affero general public license", "agpl", 0.9),
    ("gnu free documentation license", "gfdl", 0.9),
    ("creative commons attribution", "cc-by", 0.8),
    ("cc by sa", "cc-by-sa", 0.9),
    ("creative commons attribution sharealike", "cc-by-sa", 0.9),
    ("cc by nc", "cc-by-nc", 0.9),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.9),
    ("cc by nc sa", "cc-by-nc-sa", 0.9),
    ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("cc0 1 0", "cc0-1.0", 0.9),
    ("creative commons zero", "cc0-1.0", 0.9),
    ("dedicated to the public domain", "public-domain", 0.9),
    ("released into the public domain", "public-domain", 0.9),
    ("free and unencumbered software released into the public domain", "unlicense", 0.95),
    ("do what the fuck you want to public license", "wtfpl", 0.95),
    ("boost software license", "bsl-1.0", 0.9),
]
#: How surely the base phrases state their licence.
BASE_WEIGHTS = {"cc-by": 0.8, "gpl": 0.8, "reserved": 0.6}

TAGS = ["spdx-license-identifier:", "license-expression:"]

#: How freely a text under a licence may be used again: 1 permissive, 0 not at all.
PERMISSIVE, FILE_COPYLEFT, COPYLEFT, RESTRICTED, UNKNOWN = 1.0, 0.6, 0.3, 0.1, 0.0
FAMILIES = [
    (r"0bsd|apache(-[\d.]+)?|bsd(-\d-clause.*)?|mit(-0)?|isc|zlib|bsl-1\.0|python-2\.0|psf-2\.0|ncsa|postgresql|wtfpl", PERMISSIVE),
    (r"cc0-1\.0|unlicense|public-domain|cc-by(-\d.*)?|cc-pddc|odc-by-1\.0|pddl-1\.0", PERMISSIVE),
    (r"(lgpl|mpl|epl|cddl)(-[\d.]+)?(-only|-or-later|\+)?", FILE_COPYLEFT),
    (r"(gpl|agpl|gfdl|eupl|osl)(-[\d.]+)?(-only|-or-later|\+)?|cc-by-sa(-\d.*)?|odbl-1\.0", COPYLEFT),
    (r"cc-by-n[cd].*|reserved|busl-1\.1|sspl-1\.0|elastic-2\.0", RESTRICTED),
]
_FAMILIES = [(re.compile(p), v) for p, v in FAMILIES]
#: Additions that allow linking, and so loosen the licence they stand with.
EXCEPTIONS = re.compile(r".*(classpath|linking|runtime|llvm|font|bison|autoconf|openssl|gcc|syscall-note|swift|qt).*")

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_TOKEN = re.compile(r"[ \t]*(?:([()/])|([a-z0-9][a-z0-9.+:_-]*)|$)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


# -- expressions ------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def freedom(identifier: str) -> float | None:
    """How freely text under a licence may be used; None for identifiers not known here."""
    for pattern, value in _FAMILIES:
        if pattern.fullmatch(identifier):
            return value
    return None


@dataclass(frozen=True)
class Value:
    """What an expression or a part of it comes to."""

    labels: frozenset[str]
    certainty: float  # 1 if every identifier that counts is known
    free: float  # by the choices that ``or`` leaves and the duties that ``and`` joins

    @classmethod
    def of(cls, identifier: str) -> Value:
        known = freedom(identifier)
        if known is None:
            return cls(frozenset(["other"]), 0.5, UNKNOWN)
        return cls(frozenset([identifier]), 1.0, known)


def _combined(operator: str, left: Value, right: Value) -> Value:
    if operator == "or":  # one may choose
        return Value(left.labels | right.labels, max(left.certainty, right.certainty), max(left.free, right.free))
    if operator == "and":  # all must be kept
        return Value(left.labels | right.labels, min(left.certainty, right.certainty), min(left.free, right.free))
    loosened = "exception" in right.labels
    free = max(left.free, FILE_COPYLEFT) if loosened and left.free == COPYLEFT else left.free
    return Value(left.labels, left.certainty * (1.0 if loosened else 0.5), free)


def evaluate(text: str) -> tuple[Value | None, bool]:
    """Value of the expression at the start of ``text`` (lower case), and whether it is well formed.

    ``with`` binds tighter than ``and``, that tighter than ``or``; ``/`` means ``or``.  The
    expression ends where no token can go on with it.  An operator without its right side or
    a parenthesis left open makes it ill-formed: what stands complete is evaluated all the
    same.  None if there is no identifier.
    """
    values: list[Value] = []
    operators: list[str] = []

    def reduce_one() -> None:
        right, left = values.pop(), values.pop()
        values.append(_combined(operators.pop(), left, right))

    at, operand_next, well = 0, True, True
    while True:
        match = _TOKEN.match(text, at)
        if not match or not match.group(0).strip():
            break
        sign, word = match.groups()
        if sign == "/" or (word in _PRECEDENCE):
            if operand_next:
                break
            operator = "or" if sign else word
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[operator]:
                reduce_one()
            operators.append(operator)
            operand_next = True
        elif sign == "(":
            if not operand_next:
                break
            operators.append("(")
        elif sign == ")":
            if operand_next or "(" not in operators:
                break
            while operators[-1] != "(":
                reduce_one()
            operators.pop()
        else:
            if not operand_next:
                break
            word = word.rstrip(".:-_")  # a sentence may end here
            if operators and operators[-1] == "with":
                kind = "exception" if EXCEPTIONS.fullmatch(word) else "other"
                values.append(Value(frozenset([kind]), 1.0, PERMISSIVE))
            else:
                values.append(Value.of(word))
            operand_next = False
        at = match.end()
    while operators and operand_next:  # no right side came: the operator goes, and parentheses opened for it
        operand_next, well = operators.pop() == "(", False
    while operators:
        if operators[-1] == "(":
            operators.pop()
            well = False
        else:
            reduce_one()
    return (values[-1], well) if values else (None, False)


# -- search -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Phrases to look for: words, label, weight, and whether the phrase is a base one."""

    phrases: tuple[tuple[str, str, float, bool], ...]
    tags: tuple[str, ...] = tuple(TAGS)

    @classmethod
    def standard(cls) -> Rules:
        base = [(p, label, BASE_WEIGHTS[label], True) for p, label in BASE_PHRASES.items()]
        return cls(tuple(base + [(p, label, weight, False) for p, label, weight in PHRASES]))


class Scanner:
    """Two automata: phrases over the words of a text, tags over its characters."""

    def __init__(self, rules: Rules):
        self.phrases = ahocorasick.Automaton()
        by_phrase: dict[str, list] = {}
        for phrase, label, weight, base in rules.phrases:
            by_phrase.setdefault(f" {phrase} ", []).append((label, len(phrase.split()), weight, base))
        for phrase, meanings in by_phrase.items():
            self.phrases.add_word(phrase, (len(phrase), meanings))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in rules.tags:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words; (label, base, start, words, weight) of phrases; expressions behind tags."""
        words = text.translate(_WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        # Bytes as characters: patterns are ASCII, so nothing else can match them.
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = [(end + 1 - size, meanings) for end, (size, meanings) in self.phrases.iter(joined)]
        found = []
        if hits:
            begins = np.cumsum([0, *[len(w) + 1 for w in words]])  # the blank before each word
            starts = np.searchsorted(begins, [h[0] for h in hits]).tolist()
            found = [(label, base, s, n, weight) for s, (_, meanings) in zip(starts, hits) for label, n, weight, base in meanings]
        return len(words), found, self._expressions(text)

    def _expressions(self, text: bytes) -> list[tuple]:
        """(text, labels, certainty, freedom, well formed) of what follows each tag on its line."""
        lower = text.lower().decode("latin-1")
        places = [(end + 1 - size, end + 1) for end, size in self.tags.iter(lower)]
        out = []
        for (_, begin), (following, _) in zip(places, [*places[1:], (len(lower), 0)]):
            line = re.split(r"[\r\n]|\*/|-->|[\"'<]", lower[begin : max(begin, following)], maxsplit=1)[0]
            value, well = evaluate(line)
            if value:
                shown = line.strip(" \t").encode("latin-1").decode("utf-8", "replace")
                out.append((shown, sorted(value.labels), value.certainty * (1.0 if well else 0.6), value.free, well))
        return out


_FOUND = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("weight", pa.float64())])
_EXPRESSION = pa.struct(
    [("text", pa.string()), ("labels", pa.list_(pa.string())), ("certainty", pa.float64()), ("free", pa.float64()), ("valid", pa.bool_())]
)
SCHEMA = (
    "n_words bigint, found array<struct<label:string,base:boolean,start:bigint,words:int,weight:double>>, "
    "expressions array<struct<text:string,labels:array<string>,certainty:double,free:double,valid:boolean>>"
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``found`` (phrases, by place) and ``expressions`` of every row.

    One scan without a shuffle; texts are read whole, a few hundred at a time.  NULL and
    empty texts have no words and nothing found; every repeated row gets its row; numbers
    may be NULL; an empty table gives no rows; other columns are not read.  Places overlap
    where phrases do, and a phrase inside a longer one counts for itself.
    """
    wanted = rules or Rules.standard()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for batch in slices(batches, 256):
            rows = [scanner.scan(t) for t in utf8_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[dict(zip(_FOUND.names, f)) for f in found] for _, found, _ in rows], pa.list_(_FOUND)),
                    pa.array([[dict(zip(_EXPRESSION.names, e)) for e in told] for _, _, told in rows], pa.list_(_EXPRESSION)),
                ],
                names=["doc_id", "n_words", "found", "expressions"],
            )

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"doc_id bigint, {SCHEMA}")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """One row of figures per row of ``scan``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from base phrases;
    ``labels`` also from the others and from expressions; ``score`` is how surely the text
    states a licence: the surest of its phrases and expressions, 0 without any.  ``free`` is
    how freely it may be used, by the strictest statement; NULL without any.
    """
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])
    label = lambda f: f["label"]
    weights = F.concat(F.transform("found", lambda f: f["weight"]), F.transform("expressions", lambda e: e["certainty"]))
    told = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, label)).alias("base_labels"),
        _joined(F.concat(F.transform("found", label), told)).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("expressions").cast("bigint").alias("n_expressions"),
        F.array_min(F.transform("expressions", lambda e: e["free"])).alias("free"),
    )
