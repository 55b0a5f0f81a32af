"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>> ... <<end>>`` is an optional
region, ``<<var:a-b>>`` a replaceable one of a to b arbitrary words. Each template
compiles to a token automaton; it accepts a stretch of a text whose mandatory
words match exactly, word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

# The phrases and labels of the base scan.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# License wording with markup, as (label, template).
TEMPLATES = (
    ("mit", "under the <<opt>>terms of the<<end>> mit <<opt>>expat<<end>> license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "<<var:0-2>> the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies "
        "or substantial portions of the software",
    ),
    ("apache-2", "apache license <<opt>>version<<end>> 2 0"),
    ("apache-2", "apache license version 2"),
    ("gpl-3", "gnu general public license <<opt>>as published by the free software foundation either<<end>> version 3"),
    ("gpl-2", "gnu general public license <<opt>>as published by the free software foundation either<<end>> version 2"),
    ("lgpl", "gnu <<opt>>lesser<<end>> <<opt>>library<<end>> lesser general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("mpl-2", "mozilla public license <<opt>>version<<end>> <<opt>>v<<end>> 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted <<opt>>subject to the limitations in the disclaimer below<<end>> "
        "provided that the following conditions are met",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution non commercial <<var:0-3>> license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "cc by <<opt>>version<<end>> 4 0"),
    ("cc-by", "cc by <<opt>>version<<end>> 3 0"),
    ("cc0", "cc0 1 0 <<opt>>universal<<end>>"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "<<var:0-2>> the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies "
        "or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and <<opt>>non infringement<<end>> <<opt>>noninfringement<<end>> in no event shall the "
        "<<var:1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and <<var:1-6>> disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:1-6>> be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<var:0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<var:0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution <<opt>>and<<end>> this software is provided by <<var:1-12>> as is and any express or implied warranties",
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<var:0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<var:0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution <<var:0-1>> neither the name <<opt>>s<<end>> of <<var:1-12>> nor the "
        "names of <<opt>>its<<end>> <<opt>>the<<end>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at <<var:1-10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ),
    (
        "gpl-3",
        "<<opt>>this program is<<end>> free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or <<opt>>at your option<<end>> any later version",
    ),
    (
        "gpl-2",
        "<<opt>>this program is<<end>> free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or <<opt>>at your option<<end>> any later version",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
        "and redistribute it freely subject to the following restrictions",
    ),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def parse(template: str) -> list:
    """Markup -> list of words, (low, high) gaps, and lists for optional regions."""
    top: list = []
    stack = [top]
    for part in re.findall(r"<<opt>>|<<end>>|<<var:\d+-\d+>>|[^\s<>]+", template):
        if part == "<<opt>>":
            stack.append([])
        elif part == "<<end>>":
            inner = stack.pop()
            stack[-1].append(inner)
        elif part.startswith("<<var:"):
            low, high = part[6:-2].split("-")
            stack[-1].append((int(low), int(high)))
        else:
            stack[-1].append(part)
    if len(stack) != 1:
        raise ValueError(f"unbalanced markup: {template}")
    return top


def mandatory(template: str) -> int:
    """Number of words that every accepted text has."""
    return sum(isinstance(x, str) for x in parse(template))


class Automaton:
    """Token automaton of a template: states are integers, moves read one word each."""

    def __init__(self, template: str) -> None:
        self.moves: list[dict[str | None, int]] = [{}]
        self.free: list[set[int]] = [set()]
        self.final = self._chain(parse(template), 0)

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def _chain(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, str):
                self.moves[at][item] = at = self._next(at)
            elif isinstance(item, tuple):
                skips = []
                for k in range(item[1]):
                    if k >= item[0]:
                        skips.append(at)
                    self.moves[at][None] = at = self._next(at)
                for s in skips:
                    self.free[s].add(at)
            else:
                end = self._chain(item, inner := self._state())
                after = self._state()
                self.free[at] |= {inner, after}
                self.free[end].add(after)
                at = after
        return at

    def _next(self, _at: int) -> int:
        return self._state()

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def first(self) -> set[str | None]:
        return {w for s in self.closure({0}) for w in self.moves[s]}

    def accepts(self, tokens: Sequence[str], start: int) -> int:
        """End of the longest accepted stretch that begins at ``start``, or -1."""
        now, best = self.closure({0}), -1
        for i in range(start, len(tokens) + 1):
            if self.final in now:
                best = i
            if i == len(tokens):
                break
            step = {m[k] for s in now for m in (self.moves[s],) for k in (tokens[i], None) if k in m}
            if not step:
                break
            now = self.closure(step)
        return best


def token_pattern(template: str) -> str:
    """The same language as a regular expression over words joined by single spaces, each with one space after it."""

    def of(items: list) -> str:
        return "".join(f"{x} " if isinstance(x, str) else f"(?:[^ ]+ ){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f"(?:{of(x)})?" for x in items)

    return "(?:^| )" + of(parse(template))


def confidence(template: str) -> float:
    """The more mandatory words, the surer: 1 - 1/(1 + words)."""
    return 1 - 1 / (1 + mandatory(template))


#: Bytes to bytes: A-Z to lower case; what is no word character becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """Scans texts for base phrases and templates."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> None:
        self.base = [(label, f" {phrase} ".encode()) for label, phrase in base]
        self.starts: dict[str, list[tuple[str, Automaton, float]]] = {}
        self.floor = {label: confidence(phrase) for label, phrase in base}
        # A text that lacks a mandatory word of each template and phrase needs no automaton; the longest words, which are the rarest, come first.
        needed = [phrase.split() for _, phrase in base] + [[x for x in parse(t) if isinstance(x, str)] for _, t in templates]
        self.gates = [tuple(x.encode("utf-8", "surrogatepass") for x in sorted(set(words), key=lambda x: (-len(x), x))) for words in needed]
        for label, template in templates:
            machine = Automaton(template)
            for word in machine.first():
                if word is None:
                    raise ValueError(f"a template must begin with a word: {template}")
                self.starts.setdefault(word, []).append((label, machine, confidence(template)))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        plain = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        tokens = plain.split()
        if not any(all(w in plain for w in words) for words in self.gates):
            return len(tokens), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(tokens) + b" "
        places, found, score = [], set(), 0.0
        for label, phrase in self.base:
            at, before, counted = joined.find(phrase), 0, 0
            while at >= 0:
                # Words are counted on from the place before, not from the start.
                before, counted = before + joined.count(b" ", counted, at + 1), at + 1
                places.append(before - 1)
                found.add(label)
                score = max(score, self.floor[label])
                at = joined.find(phrase, at + 1)
        labels = set(found)
        named = joined.decode("utf-8", "surrogatepass").split(" ")[1:-1]
        for i, word in enumerate(named):
            for label, machine, sure in self.starts.get(word, ()):
                if (label not in labels or sure > score) and machine.accepts(named, i) >= 0:
                    labels.add(label)
                    score = max(score, sure)
        return len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """Scan the whole texts of ``docs`` (doc_id, text).

    One row per input row: doc_id, n_words, n_base (places of all base phrases),
    first_word and last_word (smallest and largest of their starts, in words from
    0; null if none), base_labels, labels (base ones and those of accepted
    templates; distinct, sorted, comma-joined, empty if none), score (the
    confidence of the surest match, 0 if none). Null and empty texts have no words
    and no labels; a null doc_id passes through; repeated rows each give a row;
    other columns are not read; an empty table gives an empty table.
    """
    templates, base = tuple(templates), tuple(base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, base)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(None if pd.isna(i) else int(i), *scanner.scan(t)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("doc_id", "n_words", "n_base", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(run, SCHEMA)


def scan_sql() -> str:
    """The same rows in DuckDB SQL, by regular expressions instead of automata."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    at = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{x}' ''' for k, x in enumerate(phrase.split()))})" for _, phrase in BASE]
    cases = [(label, f"regexp_matches(j, '{token_pattern(t)}')", confidence(t)) for label, t in (*BASE, *TEMPLATES)]
    labels = sorted({label for label, _, _ in cases})
    some = ", ".join(f"CASE WHEN {' OR '.join(c for n, c, _ in cases if n == label)} THEN '{label}' END" for label in labels)
    base = ", ".join(f"CASE WHEN len({a}) > 0 THEN '{label}' END" for (label, _), a in sorted(zip(BASE, at, strict=True)))
    best = ", ".join(f"CASE WHEN {c} THEN {s!r} ELSE 0.0 END" for _, c, s in cases)
    return (
        f"WITH t AS (SELECT doc_id, {words} AS w FROM documents), j AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS j, {' || '.join(at)} AS p FROM t) "
        "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word, "
        f"array_to_string(list_filter([{base}], lambda x: x IS NOT NULL), ',') AS base_labels, array_to_string(list_filter([{some}], lambda x: x IS NOT NULL), ',') AS labels, "
        f"CAST(greatest({best}) AS DOUBLE) AS score FROM j"
    )
