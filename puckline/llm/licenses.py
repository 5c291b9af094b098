"""Operator 13, license scans: template markup compiled to token automata.

A template is the wording of a license or of a notice, as words, with two
kinds of markup:

* ``[ ... ]`` is optional wording, and ``[ ... | ... ]`` a choice that may be
  left out (both may be nested);
* ``<name:m-n>`` is replaceable: any m to n words (a holder, a year, a title).

All else is mandatory and must stand in the text exactly, word by word.  A
template becomes a token automaton: states with moves on one word, on any word,
and on nothing.  All templates run as one automaton over a text's words, whose
sets of states are worked out once and kept (a lazily built deterministic
automaton); each start is followed as far as it goes and a template accepts its
longest match there.  The base phrases are templates without markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import ship

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, wording).  Notices first, then texts of whole licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under [ the ] mit license"),
    ("mit", "licensed under [ the ] [ terms of the ] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <what:1-8> and associated"
            " documentation files the <name:1-4> to deal in the <name:1-4> without restriction including without limitation"
            " the rights to use copy modify merge publish distribute sublicense and or sell copies of the <name:1-4> and to"
            " permit persons to whom the <name:1-4> is furnished to do so subject to the following conditions the above"
            " copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies"
            " or substantial portions of the <name:1-4> the <name:1-4> is provided as is without warranty of any kind express"
            " or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
            " noninfringement in no event shall <holder:1-12> be liable for any claim damages or other liability whether in an"
            " action of contract tort or otherwise arising from out of or in connection with the <name:1-4> or the use or"
            " other dealings in the <name:1-4>"),
    ("apache-2.0", "licensed under the apache license version 2 0 [ the license ] [ you may not use this <what:1-4> except in"
                   " compliance with the license [ you may obtain a copy of the license at <address:1-12> ] ]"),
    ("apache-2.0", "released under the apache license [ version ] 2 0"),
    ("gpl", "licensed under the [ terms of the ] gnu [ lesser | affero ] general public license"),
    ("gpl-2.0", "licensed under the [ terms of the ] gnu general public license version 2 [ only | or later ]"),
    ("gpl-3.0", "licensed under the [ terms of the ] gnu general public license version 3 [ only | or later ]"),
    ("gpl", "this <what:1-8> is free software [ you can | you may ] redistribute it and or modify it under the terms of the"
            " gnu general public license as published by the free software foundation [ either version <version:1-2> of the"
            " license or [ at your option ] any later version ]"),
    ("lgpl", "gnu [ lesser | library ] general public license version 2 1"),
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("cc-by-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under [ a ] [ the ] [ creative commons ] cc by nc nd 4 0"),
    ("cc-by", "this <what:1-8> is licensed under a creative commons attribution <version:0-4> license"),
    ("cc0", "cc0 1 0 [ universal ]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
            " following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice this"
            " list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above"
            " copyright notice this list of conditions and the following disclaimer in the documentation and or other"
            " materials provided with the distribution [ [ 3 ] neither the name of <holder:1-12> nor the names of its"
            " contributors may be used to endorse or promote products derived from this software without specific prior"
            " written permission ]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 [ if a copy of the mpl was"
                " not distributed with this file you can obtain one at <address:1-12> ]"),
    ("all-rights-reserved", "copyright [ c ] <year:1-2> <holder:0-8> all rights reserved"),
)

#: Sets of states that a worker keeps.
KEPT = 50_000
#: How sure a finding is: a template accepted, or no more than a base phrase.
ACCEPTED, PHRASE_ONLY = 1.0, 0.5

#: A-Z to lower case, ASCII letters, digits and all bytes of other characters stay, the rest separates.
_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))
ANY = None


def _parse(tokens: list[str], at: int = 0) -> tuple[list, int]:
    """Items of a wording: a word, (m, n) for replaceable words, or a list of
    choices (lists of items) for optional wording."""
    choices: list[list] = [[]]
    while at < len(tokens):
        token = tokens[at]
        at += 1
        if token == "[":
            inner, at = _parse(tokens, at)
            choices[-1].append(inner)
        elif token == "]":
            return choices, at
        elif token == "|":
            choices.append([])
        elif token.startswith("<"):
            least, most = re.fullmatch(r"<\w+:(\d+)-(\d+)>", token).groups()
            choices[-1].append((int(least), int(most)))
        else:
            choices[-1].append(token)
    return choices, at


class Automaton:
    """One automaton for many templates; sets of states are memoised."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.moves: list[dict[bytes | None, list[int]]] = []  # state -> word (None: any) -> states
        self.free: list[list[int]] = []  # moves on nothing
        self.accepts: dict[int, int] = {}  # state -> template
        starts = []
        for number, (_, wording) in enumerate(templates):
            first = self._state()
            starts.append(first)
            items, _ = _parse(wording.split())
            self.accepts[self._build(items[0], first)] = number
        self.start = self._closed(starts)
        self.first_words = {word for s in self.start for word in self.moves[s]}
        if ANY in self.first_words or any(s in self.accepts for s in self.start):
            raise ValueError("a template must begin with a mandatory word")
        self.known: dict[tuple[frozenset[int], bytes], tuple[frozenset[int], tuple[int, ...]]] = {}

    def _state(self) -> int:
        self.moves.append({})
        self.free.append([])
        return len(self.moves) - 1

    def _build(self, items: list, at: int) -> int:
        """Add the items after state ``at``; the state behind them."""
        for item in items:
            end = self._state()
            if isinstance(item, str):
                self.moves[at].setdefault(item.encode(), []).append(end)
            elif isinstance(item, tuple):  # any m to n words
                least, most = item
                for k in range(most):
                    if k >= least:
                        self.free[at].append(end)
                    after = self._state()
                    self.moves[at].setdefault(ANY, []).append(after)
                    at = after
                self.free[at].append(end)
            else:  # optional wording
                self.free[at].append(end)
                for choice in item:
                    first = self._state()
                    self.free[at].append(first)
                    self.free[self._build(choice, first)].append(end)
            at = end
        return at

    def _closed(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def step(self, states: frozenset[int], word: bytes) -> tuple[frozenset[int], tuple[int, ...]]:
        """The states after a word, and the templates that accept there."""
        key = (states, word)
        if key not in self.known:
            after = self._closed([x for s in states for w in (word, ANY) for x in self.moves[s].get(w, ())])
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[key] = (after, tuple(sorted({self.accepts[s] for s in after if s in self.accepts})))
        return self.known[key]

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end, template) of every start's longest match of each template."""
        out, first_words = [], self.first_words
        for at in [i for i, w in enumerate(words) if w in first_words]:
            states, ends, k = self.start, {}, at
            while k < len(words):
                states, accepted = self.step(states, words[k])
                if not states:
                    break
                k += 1
                for t in accepted:
                    ends[t] = k
            out += [(at, end, t) for t, end in sorted(ends.items())]
        return out


@cache
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    """Phrases and templates as one automaton, once for each worker process."""
    return Automaton([*((label, phrase) for phrase, label in PHRASES), *templates])


def _scanner(templates: tuple[tuple[str, str], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(templates)
        for batch in batches:
            n_words, found = [], []
            for text in batch.column("text"):
                raw = text.as_buffer()
                words = raw.to_pybytes().translate(_WORDS).split() if raw is not None else []
                n_words.append(len(words))
                found.append([{"start": a, "end": z, "label": own.labels[t], "template": t >= len(PHRASES)}
                              for a, z, t in own.find(words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, MATCHES_ARROW)],
                                             names=["doc_id", "n_words", "matches"])

    return scan


MATCHES = "array<struct<start: bigint, end: bigint, label: string, template: boolean>>"
MATCHES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("template", pa.bool_())]))


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Every match in every whole text of ``docs`` (doc_id, text): doc_id,
    n_words, and ``matches``, an array of (start, end, label, template) in
    words, end exclusive; ``template`` is false for a base phrase.

    A null text is empty and has none.  Repeated rows count each, null ids like
    others, an empty table gives an empty result; further columns are ignored.
    """
    ship(docs.sparkSession)
    fixed = tuple((str(label), str(wording)) for label, wording in templates)
    automaton(fixed)  # a wrong template fails here, not in a task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(fixed), f"doc_id long, n_words long, matches {MATCHES}")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of base
    phrases), first_word and last_word (their smallest and largest start, null
    if there is none), base_labels, labels (those of accepted templates too;
    both distinct, sorted, comma-joined) and score (1 if a template accepts,
    0.5 if there are only base phrases, else 0).  See ``find_licenses`` for
    awkward rows."""
    found = find_licenses(docs, templates)
    base = F.filter("matches", lambda m: ~m["template"])
    places = F.transform(base, lambda m: m["start"])

    def names(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: m["template"]), F.lit(ACCEPTED))
         .when(F.size(base) > 0, F.lit(PHRASE_ONLY)).otherwise(F.lit(0.0)).alias("score"))


# ----------------------------------------------------------------- SQL

def _pattern(items: list) -> str:
    """A wording as a regular expression over words that each have a space on both sides."""
    out = ""
    for item in items:
        if isinstance(item, str):
            out += f" {item} "
        elif isinstance(item, tuple):
            out += f"(?: [^ ]+ ){{{item[0]},{item[1]}}}"
        else:
            out += f"(?:{'|'.join(_pattern(choice) for choice in item)})?"
    return out


def _oracle_sql() -> str:
    """Words with a space on both sides: an occurrence shares no character with another."""
    parts = []
    for phrase, label in PHRASES:
        parts.append((_pattern(phrase.split()), label, len(phrase.split())))
    base = ", ".join(f"CASE WHEN contains(w, '{p}') THEN '{label}' END" for p, label, _ in parts)
    accepted = ", ".join(f"CASE WHEN regexp_matches(w, '{_pattern(_parse(wording.split())[0][0])}') THEN '{label}' END"
                         for label, wording in TEMPLATES)
    count = " + ".join(f"(length(w) - length(replace(w, '{p}', ''))) // {len(p)}" for p, _, _ in parts)
    size = "len(string_split(trim({0}), '  ')) - CAST(trim({0}) = '' AS INT)"
    before = ", ".join(f"CASE WHEN contains(w, '{p}') THEN {size.format(f"string_split(w, '{p}')[1]")} END" for p, _, _ in parts)
    behind = ", ".join(f"CASE WHEN contains(w, '{p}') THEN n_words - {k} - ({size.format(f"string_split(w, '{p}')[-1]")}) END"
                       for p, _, k in parts)
    return f"""
WITH t AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
         regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ',
                        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') AS spaced
  FROM documents),
v AS (SELECT doc_id, CASE WHEN trim(spaced) = '' THEN '' ELSE substr(spaced, 2, length(spaced) - 2) END AS w FROM t),
n AS (SELECT *, {size.format('w')} AS n_words FROM v),
f AS (SELECT *, {count} AS n_base, [{before}] AS firsts, [{behind}] AS lasts,
             list_filter([{base}], lambda x: x IS NOT NULL) AS bases,
             list_filter([{accepted}], lambda x: x IS NOT NULL) AS more FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base,
       CAST(list_min(firsts) AS BIGINT) AS first_word, CAST(list_max(lasts) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(bases)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(bases, more))), ',') AS labels,
       CASE WHEN len(more) > 0 THEN {ACCEPTED} WHEN n_base > 0 THEN {PHRASE_ONLY} ELSE 0.0 END::DOUBLE AS score
FROM f
"""


ORACLE_SQL = _oracle_sql()
