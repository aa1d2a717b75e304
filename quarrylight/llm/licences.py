"""Licence scans: Aho-Corasick phrase search and a shunting-yard evaluator of licence expressions.

Defined results. Null text: no words, no places. Overlapping phrases each count at each place. An expression that does
not parse adds the label `invalid-expression`. Long texts are scanned whole; repeated rows are scanned each by itself.
Rows without an id are scanned like any other and keep their null id. An empty table gives none. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: phrases whose places count as base, and their labels
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: notice phrases of the method
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: licences that count as permissive when an expression is evaluated
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c < 0x5B else c if 0x30 <= c < 0x3A or 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in range(256)
)
_EXPRESSION = re.compile(rb"spdx-license-identifier[ \t]*[:=]?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.-]+)?")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Postfix form of a licence expression by the shunting-yard method; None where it does not parse."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                break  # words after a complete expression are prose
            out.append(low)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate_expression(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, set[str]]:
    """(whether the licensee can choose allowed terms only, licence ids named). `with` keeps its left side's verdict."""
    stack: list[tuple[bool, str]] = []
    ids: set[str] = set()
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                ids.discard(right[1])
                stack.append(left)
            else:
                stack.append((left[0] or right[0] if token == "or" else left[0] and right[0], ""))
        else:
            ids.add(token)
            stack.append((token.removesuffix("+") in allowed, token))
    return stack[0][0], ids


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        a.add_word(f" {phrase} ", (False, label, len(phrase)))
    for phrase, label in BASE_PHRASES.items():
        a.add_word(f" {phrase} ", (True, label, len(phrase)))
    a.add_word(f" {TAG} ", (False, "", len(TAG)))
    a.make_automaton()
    return a


def scan_text(text: str, automaton) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    raw = text.encode()
    words = raw.translate(_TO_WORDS).split()
    joined = f" {b' '.join(words).decode(errors='surrogateescape')} "
    n_base, starts, base, labels, tagged = 0, [], set(), set(), False
    for end, (is_base, label, length) in automaton.iter(joined):
        if is_base:
            n_base += 1
            base.add(label)
            starts.append(end - length)  # place of the phrase's first character
        if label:
            labels.add(label)
        else:
            tagged = True
    permissive: bool | None = None
    if tagged:
        for m in _EXPRESSION.finditer(raw):
            postfix = parse_expression(m[1].decode(errors="replace"))
            if postfix is None:
                labels.add("invalid-expression")
                continue
            verdict, ids = evaluate_expression(postfix)
            labels |= ids
            permissive = verdict if permissive is None else permissive and verdict
    first = joined.count(" ", 0, min(starts)) - 1 if starts else None
    last = joined.count(" ", 0, max(starts)) - 1 if starts else None
    evidence = n_base + len(labels) + 2 * tagged
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - 0.5**evidence, permissive


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, permissive boolean"
)
_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_())]
)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document; texts are scanned where they are read, nothing is shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            rows = [scan_text(t.as_py() or "", automaton) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.record_batch([b.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(_TYPES)[1:], strict=True)]], schema=_TYPES)

    return docs.select(id_col, text).mapInArrow(scan, SCHEMA)
