"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is a text in the markup that published license lists use: ``<<beginOptional>>``
... ``<<endOptional>>`` encloses wording that may be absent (regions nest), and
``<<var;max=N>>`` stands for up to N words of any kind (``min=M`` asks for at least M).
Everything else is mandatory and must stand word for word. Case, punctuation and white
space do not count, because both sides are compared as words.

Each template becomes an automaton over words without empty moves: states are places in
the template, an edge carries a word or "any word". A text is read once per template, and
only if it has all mandatory words of the template, which a set of its words decides.
Texts are independent of each other, so no row leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from vesselflow.llm.common import lower_a_z, table

#: After lower-casing A-Z: digits, letters a-z and every character that is not ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[a-z]+=\d+)*)>>")

# The phrases of the base labels.
BASE_PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

# Wording of public licenses and of the notices that point to them.
# label, weight of the evidence, template.
_GNU_NAMES = (
    ("gpl", "GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("agpl", "GNU Affero General Public License"),
)
_GNU_NOTICES = (
    "licensed under <<beginOptional>>the terms of<<endOptional>> the {name}<<beginOptional>>, <<beginOptional>>either<<endOptional>> version <<var;min=1;max=2>><<endOptional>>",
    "redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation<<beginOptional>>, <<beginOptional>>either<<endOptional>> version <<var;min=1;max=2>> of the License<<endOptional>>",
)
_GNU_TEXT = "{name} Version <<var;min=1;max=2>> <<var;min=3;max=3>> Copyright <<beginOptional>>(C)<<endOptional>> <<var;min=1;max=4>> Free Software Foundation, Inc. <<var;max=12>> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC_TERMS = (
    ("cc-by", "Attribution", "BY"),
    ("cc-by-sa", "Attribution-ShareAlike", "BY-SA"),
    ("cc-by-nd", "Attribution-NoDerivatives", "BY-ND"),
    ("cc-by-nd", "Attribution-NoDerivs", "BY-ND"),
    ("cc-by-nc", "Attribution-NonCommercial", "BY-NC"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivs", "BY-NC-ND"),
)

# Words that make another license are mandatory, so each license has templates of its own.
TEMPLATES = (
    *[(f"{label}-notice", 1.0, notice.format(name=name)) for label, name in _GNU_NAMES for notice in _GNU_NOTICES],
    *[(f"{label}-text", 1.0, _GNU_TEXT.format(name=name)) for label, name in _GNU_NAMES],
    ("apache-2.0", 1.0, "Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0<<beginOptional>> (the \"License\"); you may not use this <<var;min=1;max=4>> except in compliance with the License<<endOptional>>"),
    ("apache-2.0-text", 1.0, "Apache License Version 2.0, January 2004 <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    *[(label, 1.0, f"Creative Commons {terms}") for label, terms, _ in _CC_TERMS],
    *[(label, 1.0, f"CC {short}") for label, short in dict((x, y) for x, _, y in _CC_TERMS).items() if label != "cc-by"],
    ("cc0", 1.0, "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    ("mit-notice", 1.0, "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the MIT License"),
    ("mit-text", 1.0, "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;min=1;max=8>> (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc-text", 1.0, "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", 1.0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2.0", 1.0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://mozilla.org/MPL/2.0/."),
    ("unlicense", 1.0, "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", 0.8, "Copyright <<beginOptional>>(c)<<endOptional>> <<var;min=1;max=8>> All rights reserved"),
)
#: Weight of a bare mention of a license's name.
BASE_WEIGHT = 0.6

ANY = None


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_a_z(text or ""))


class Automaton:
    """A template over words: ``edges[state]`` has (word or ANY, next state), ``ends`` accept.

    ``least`` counts the mandatory words, ``needed`` has them as a set."""

    def __init__(self, label: str, weight: float, template: str, base: bool = False):
        self.label, self.weight, self.template, self.base = label, weight, template, base
        edges: list[list[tuple[str | None, int]]] = [[]]
        skips: list[list[int]] = [[]]
        self.needed: set[str] = set()
        here, opened, at = 0, [], 0

        def step(word):
            nonlocal here
            edges[here].append((word, len(edges)))
            here = len(edges)
            edges.append([])
            skips.append([])

        def wording(piece):
            for word in words_of(piece):
                step(word)
                if not opened:
                    self.needed.add(word)

        for mark in _MARK.finditer(template):
            wording(template[at : mark.start()])
            at = mark.end()
            kind, options = mark[1], dict(x.split("=") for x in mark[2].split(";") if x)
            if kind == "beginOptional":
                opened.append(here)
            elif kind == "endOptional":
                if not opened:
                    raise ValueError(f"endOptional without a begin in {template!r}")
                skips[opened.pop()].append(here)
            else:
                most, least = int(options.get("max", 1)), int(options.get("min", 0))
                entries = []
                for k in range(most):
                    if k >= least:
                        entries.append(here)
                    step(ANY)
                for entry in entries:
                    skips[entry].append(here)
        wording(template[at:])
        if opened:
            raise ValueError(f"optional region without an end in {template!r}")
        if not self.needed:
            raise ValueError(f"a template needs mandatory wording: {template!r}")
        closure = []
        for state in range(len(edges)):
            seen, todo = {state}, [state]
            while todo:
                for nxt in skips[todo.pop()]:
                    if nxt not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            closure.append(seen)
        self.exact: list[dict[str, list[int]]] = []
        self.free: list[list[int]] = []
        for state in range(len(edges)):
            exact: dict[str, list[int]] = {}
            free: list[int] = []
            for near in closure[state]:
                for word, nxt in edges[near]:
                    (free if word is ANY else exact.setdefault(word, [])).append(nxt)
            self.exact.append(exact)
            self.free.append(free)
        self.ends = {s for s in range(len(edges)) if here in closure[s]}
        self.starts = None if self.free[0] else frozenset(self.exact[0])

    def matches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(start, end) of each place where the template holds: the longest for each start."""
        if self.starts is None:
            places = range(len(words))
        else:
            places = [i for i, word in enumerate(words) if word in self.starts]
        exact, free, ends = self.exact, self.free, self.ends
        for start in places:
            states, i, found = {0}, start, None
            while states and i < len(words):
                word, after = words[i], set()
                for state in states:
                    after.update(exact[state].get(word, ()))
                    after.update(free[state])
                states, i = after, i + 1
                if not ends.isdisjoint(states):
                    found = i
            if found is not None:
                yield start, found


def compile_templates(templates=TEMPLATES, phrases=BASE_PHRASES) -> list[Automaton]:
    """Base phrases are templates without regions; they come first and keep their labels."""
    base = [Automaton(label, BASE_WEIGHT, phrase, True) for label, phrase in phrases.items()]
    return base + [Automaton(label, weight, text) for label, weight, text in templates]


def scan_words(words: list[str], automata: list[Automaton]) -> list[tuple[int, int, int]]:
    """(automaton, start, end) of all matches in the words of a text.

    What stands inside a longer match from the same place on is part of that wording: ``CC
    BY-NC-SA`` is not ``CC BY-NC`` as well. Base phrases always count."""
    have = set(words)
    found = [
        (k, start, end)
        for k, automaton in enumerate(automata)
        if automaton.needed <= have
        for start, end in automaton.matches(words)
    ]
    longest: dict[int, int] = {}
    for _, start, end in found:
        longest[start] = max(longest.get(start, 0), end)
    return [(k, start, end) for k, start, end in found if automata[k].base or end == longest[start]]


MATCHES = "array<struct<label:string,base:boolean,start:bigint,end:bigint,weight:double>>"


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES
) -> DataFrame:
    """One row for each row of ``docs``: the key, n_words and ``matches``.

    A match has label, whether it is a base phrase, first word and the word after its last
    (words count from 0), and weight. A null text is an empty one: no words, no matches.
    Repeated rows give repeated rows; a null key is kept; other columns are not read.
    """
    automata = compile_templates(templates, phrases)
    n_base = len(phrases)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(
            pa.struct(
                [("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]
            )
        )
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                counts.append(len(words))
                found.append(
                    [
                        (automata[k].label, k < n_base, start, end, automata[k].weight)
                        for k, start, end in scan_words(words, automata)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([[dict(zip(("label", "base", "start", "end", "weight"), m, strict=True)) for m in row] for row in found], kind)],
                ["_key", "n_words", "matches"],
            )

    source = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    schema = f"_key {docs.schema[key].dataType.simpleString()}, n_words bigint, matches {MATCHES}"
    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its license phrases (base) and all labels.

    ``score`` is the weight of the strongest match, 0 without one.
    """
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        "transform(filter(matches, m -> m.base), m -> m.start) as starts",
        "transform(filter(matches, m -> m.base), m -> m.label) as base_found",
        "matches",
    ).selectExpr(
        "doc_id",
        "n_words",
        "bigint(size(starts)) as n_base",
        "array_min(starts) as first_word",
        "array_max(starts) as last_word",
        "array_join(array_sort(array_distinct(base_found)), ',') as base_labels",
        "array_join(array_sort(array_distinct(transform(matches, m -> m.label))), ',') as labels",
        "coalesce(array_max(transform(matches, m -> m.weight)), 0D) as score",
        "matches",
    )
