"""License scan: Aho-Corasick over words, shunting-yard over licence expressions.

A text is read as its words: A-Z lower-cased, then runs of characters other than the ASCII
ones that are neither letter nor digit. One automaton holds all notice phrases, bounded by
single spaces, and runs once over the words of a text joined by single spaces; so a phrase is
found wherever its words stand consecutively, whatever separates them. Where the words of an
SPDX tag occur, the tag's expression is taken from the raw text to the end of its line, turned
into postfix by the shunting-yard algorithm (with binds tighter than and, and tighter than
or) and evaluated.

Defined cases: null text is the empty text, with no words and no labels; repeated rows give
repeated results; very long texts take time in proportion to their length; an empty table has no
rows; columns of other names, or names that differ only by case, fall away; an expression that
doesn't parse gives the label spdx-invalid and no others.
"""
from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import doc_columns, map_rows

# The phrases and labels of the contract.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels that the method adds.
NOTICE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "creative-commons",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "copyright": "copyright",
}

SPDX_WORDS = "spdx license identifier"
_SPDX_TAG = re.compile(r"(?i)spdx[^\S\n]*-?[^\S\n]*license[^\S\n]*-?[^\S\n]*identifier[^\S\n]*:?[^\S\n]*([^\n]*)")

_SEPARATORS = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))

PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib", "cc-by-4.0"})

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, expressions array<string>, score double"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


# --- licence expressions -------------------------------------------------------------------

_RANK = {"or": 1, "and": 2, "with": 3}
_PIECE = re.compile(r"[()]|[A-Za-z0-9.+:\-]+|(\S)")


def parse_expression(text: str) -> list[tuple[str, str]] | None:
    """Postfix of a licence expression, as (kind, value) pairs; None if it doesn't parse.

    A trailing comment closer or sentence mark is not part of the expression.
    """
    text = re.sub(r"(\*/|-->|\"|'|[.;,])+\s*$", "", text.strip()).strip()
    out: list[tuple[str, str]] = []
    held: list[str] = []
    operand_next = True
    for m in _PIECE.finditer(text):
        if m[1]:
            return None
        word = m[0]
        low = word.lower()
        if low in _RANK:
            if operand_next:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(("op", held.pop()))
            held.append(low)
            operand_next = True
        elif word == "(":
            if not operand_next:
                return None
            held.append(word)
        elif word == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(("op", held.pop()))
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(("id", low))
            operand_next = False
    if operand_next or "(" in held:
        return None
    while held:
        out.append(("op", held.pop()))
    return out


def evaluate(postfix: list[tuple[str, str]], allowed=PERMISSIVE) -> bool:
    """Whether the licence may be chosen from the allowed ones: or needs one side, and needs both;
    an exception (with) only widens the licence before it."""
    stack: list[bool] = []
    for kind, value in postfix:
        if kind == "id":
            stack.append(value.rstrip("+") in allowed)
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if value == "or" else left and right if value == "and" else left)
    return stack[0]


def identifiers(postfix: list[tuple[str, str]]) -> set[str]:
    """Licence ids of an expression; what follows a with is an exception, not a licence."""
    stack: list[set[str]] = []
    for kind, value in postfix:
        if kind == "id":
            stack.append({value})
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left if value == "with" else left | right)
    return stack[0]


# --- scan -----------------------------------------------------------------------------------


def build_automaton(base: dict[str, str], notices: dict[str, str]):
    machine = ahocorasick.Automaton()
    for phrase in {*base, *notices, SPDX_WORDS}:
        spaced = b" ".join(words_of(phrase)).decode("latin-1")
        key = f" {spaced} "
        machine.add_word(key, (len(key), base.get(phrase), notices.get(phrase), phrase == SPDX_WORDS))
    machine.make_automaton()
    return machine


def scan_text(machine, text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, expressions, score)."""
    words = words_of(text)
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    starts, base, labels, places, tagged = [], set(), set(), 0, False
    for end, (length, base_label, notice_label, spdx) in machine.iter(joined) if joined else ():
        if base_label:
            starts.append(end - length + 1)
            base.add(base_label)
            labels.add(base_label)
        if notice_label:
            labels.add(notice_label)
        tagged |= spdx
        places += 1
    expressions = []
    if tagged:
        for m in _SPDX_TAG.finditer(text):
            postfix = parse_expression(m[1])
            if postfix is None:
                labels.add("spdx-invalid")
                continue
            expressions.append(" ".join(v for _, v in postfix))
            labels.update(f"spdx:{x}" for x in identifiers(postfix))
            labels.add("spdx-permissive" if evaluate(postfix) else "spdx-restricted")
    first = last = None
    if starts:
        first, last = joined.count(" ", 0, min(starts)), joined.count(" ", 0, max(starts))
    score = places / (places + 1.0)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), expressions, score


_MACHINES: dict = {}


def scan(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES) -> DataFrame:
    """One row per document; narrow, so there is no shuffle and a lost task is simply run again."""
    key = (tuple(base.items()), tuple(notices.items()))

    def run(c):
        machine = _MACHINES.get(key)
        if machine is None:
            machine = _MACHINES[key] = build_automaton(dict(base), dict(notices))
        rows = [scan_text(machine, t) for t in c["text"].to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 8
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score")
        return {"doc_id": c["doc_id"], **dict(zip(names, cols))}

    return map_rows(doc_columns(docs, "doc_id", "text"), run, SCHEMA)
