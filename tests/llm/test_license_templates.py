import random
import re

import pytest

from vesselflow.llm import license_templates as L


def brute_base(text):
    """n_words, places and labels of the base phrases, by comparing every place."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]
    hits = []
    for label, phrase in L.BASE_PHRASES.items():
        own = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), hits


def sample(n=200):
    rng = random.Random(8)
    parts = ["GNU General Public License", "gnu general", "Apache-License", "CC BY", "cc by cc by", "MIT license", "mit", "License", "É MIT\tLICENSE", "_cc_by_", "the", "1", "ſ"]
    return ["  ".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(n)] + ["", None, "ccby"]


def test_base_columns_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(sample())]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in L.op1_license_scans(spark, str(tmp_path)).collect():
        n, hits = brute_base(rows[r.doc_id][1])
        places = [i for i, _ in hits]
        assert (r.n_words, r.n_base) == (n, len(hits))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        labels = set(filter(None, r.labels.split(",")))
        assert {label for _, label in hits} <= labels and (r.score > 0) == bool(labels) and r.score <= 1


def brute_match(parts, words):
    """Does a template given as nested parts match all the words? By trying every choice."""
    if not parts:
        return not words
    kind, value = parts[0]
    if kind == "w":
        return bool(words) and words[0] == value and brute_match(parts[1:], words[1:])
    if kind == "o":
        return brute_match(parts[1:], words) or brute_match(value + parts[1:], words)
    least, most = value
    return any(brute_match(parts[1:], words[k:]) for k in range(least, min(most, len(words)) + 1))


def markup(parts):
    out = []
    for kind, value in parts:
        if kind == "w":
            out.append(value)
        elif kind == "o":
            out.append(f"<<beginOptional>>{markup(value)}<<endOptional>>")
        else:
            out.append(f"<<var;min={value[0]};max={value[1]}>>")
    return " ".join(out)


def test_automata_accept_what_the_template_says():
    rng = random.Random(2)

    def parts(depth):
        made = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice("wwwov") if depth else "w"
            made.append((kind, rng.choice("abc") if kind == "w" else parts(depth - 1) if kind == "o" else (rng.randrange(2), rng.randrange(1, 3))))
        return made

    for _ in range(60):
        own = [("w", "a"), *parts(2)]
        automaton = L.Automaton("x", 1.0, markup(own))
        for _ in range(20):
            words = ["a", *rng.choices("abcd", k=rng.randrange(6))]
            expected = max((e for e in range(1, len(words) + 1) if brute_match(own, words[:e])), default=None)
            assert dict(automaton.matches(words)).get(0) == expected


def test_optional_and_replaceable_wording_of_known_licenses():
    automata = L.compile_templates()

    def labels(text):
        words = L.words_of(text)
        return {automata[k].label for k, _, _ in L.scan_words(words, automata)}

    assert labels("Licensed under CC BY-NC-SA 4.0.") == {"cc-by", "cc-by-nc-sa"}
    assert labels("It is CC BY-NC") == {"cc-by", "cc-by-nc"} and labels("CC BY 4.0") == {"cc-by"}
    assert labels("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License") == {"cc-by-nc-sa"}
    assert labels("a Creative Commons Attribution 4.0 International License") == {"cc-by"}
    under = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, version 3 of the License"
    assert labels(under.format("")) == {"gpl", "gpl-notice"}
    assert labels(under.format("Lesser ")) == labels(under.format("Library ")) == {"lgpl-notice"}
    assert labels("licensed under the terms of the GNU Affero General Public License, either version 3") == {"agpl-notice"}
    heading = "GNU {}GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    assert labels(heading.format("")) == {"gpl", "gpl-text"} and labels(heading.format("LESSER ")) == {"lgpl-text"}
    apache = "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
    assert labels(apache) == {"apache", "apache-2.0-text"}
    text = next(t for label, _, t in L.TEMPLATES if label == "mit-text")
    plain = re.sub("<<var[^>]*>>", "this thing and its manual", re.sub("<<beginOptional>>.*?<<endOptional>>", "", text))
    assert "mit-text" in labels(plain.upper())
    assert "mit-text" not in labels(plain.replace("sublicense", "license"))
    assert labels("nothing of the kind") == set()


@pytest.mark.parametrize("text", ["a <<beginOptional>> b", "a <<endOptional>>", "<<var>>", "<<beginOptional>>a<<endOptional>>"])
def test_broken_templates_are_refused(text):
    with pytest.raises(ValueError):
        L.Automaton("x", 1.0, text)


def test_rows_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "MIT License"), (1, None), (2, ""), (2, ""), (3, "x " * 200_000 + "cc by")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, [m.start for m in r.matches]) for r in L.scan_licenses(docs).collect())
    assert got == [(0, 2, [0]), (1, 0, []), (2, 0, []), (2, 0, []), (3, 200_002, [200_000])]
    assert L.scan_licenses(docs.limit(0)).count() == 0
