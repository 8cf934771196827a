"""Secret scans: automata inferred from labelled credentials score every candidate string.

Credentials of a kind look alike: a fixed beginning, an alphabet, a length. Nobody writes
these grammars down here. They are inferred from labelled examples: the prefix tree of the
examples of a kind is built, and states whose statistics do not differ significantly are
merged (``automata``). Labels come from two sides: strings that the base patterns find in
the corpus, and examples of publicly documented token formats, made by rule. Ordinary long
strings of the corpus train the background. A candidate is a secret of the kind whose
automaton accepts it with a length and a likelihood per character in the range of the
examples and clearly above the background's. A string that is no secret as a whole may hold
one, joined to other text: its parts are judged alike, from where a format's common
beginning stands.

The corpus sample is bounded: of each kind the ``MAX_EXAMPLES`` strings with the smallest
hash. Each task keeps so many, so the choice does not depend on the partitioning. Scanning
itself covers every whole text and moves no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm.automata import ProbabilisticAutomaton
from vesselflow.llm.common import slices, table

#: Labelled strings of a kind that training takes from the corpus, and of each rule-made format.
MAX_EXAMPLES = 300
#: A format must explain a candidate by so many nats better than the background.
MARGIN = 12.0
#: What joins a secret to other text in one string, and characters that a format's examples
#: must begin with alike to be looked for inside of strings.
JOINTS, LEAST_PREFIX = "/.-_+=", 3
#: Slack below the least likely example, in nats per character.
SLACK = 0.1

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Publicly documented token formats as (name, [(literal or alphabet, length)]);
# length 0 marks a literal.
FORMATS = (
    ("access key id", [("AKIA", 0), (_UPPER + "234567", 16)]),
    ("secret access key", [(_DIGITS + _LOWER + _UPPER + "+/", 40)]),
    ("personal access token", [("ghp_", 0), (_DIGITS + _LOWER + _UPPER, 36)]),
    ("project access token", [("glpat-", 0), (_DIGITS + _LOWER + _UPPER + "-_", 20)]),
    ("bot token", [("xoxb-", 0), (_DIGITS, 12), ("-", 0), (_DIGITS, 12), ("-", 0), (_DIGITS + _LOWER + _UPPER, 24)]),
    ("payment key", [("sk_live_", 0), (_DIGITS + _LOWER + _UPPER, 24)]),
    ("browser api key", [("AIza", 0), (_DIGITS + _LOWER + _UPPER + "-_", 35)]),
    ("mail api key", [("SG.", 0), (_DIGITS + _LOWER + _UPPER + "-_", 22), (".", 0), (_DIGITS + _LOWER + _UPPER + "-_", 43)]),
    ("package token", [("npm_", 0), (_DIGITS + _LOWER + _UPPER, 36)]),
    ("signed web token", [("eyJhbGciOi", 0), (_DIGITS + _LOWER + _UPPER + "-_", 26), (".eyJ", 0), (_DIGITS + _LOWER + _UPPER + "-_", 60), (".", 0), (_DIGITS + _LOWER + _UPPER + "-_", 43)]),
)


#: Long strings that are no secrets, for corpora that have few.
ORDINARY = (
    "internationalization notwithstanding characteristically straightforwardness responsibilities "
    "www.example.com/index.html docs/getting-started/installation.md src/main/java/org/example/App.java "
    "2024-01-01T00-00-00 1234567890123456 0000000000000000 one-two-three-four-five some_function_name_here "
    "THE-QUICK-BROWN-FOX-JUMPS README-FIRST-PLEASE.txt CamelCaseClassNameForTests http-equiv-content-type "
    "Donaudampfschifffahrtsgesellschaft anticonstitucionalmente disproportionnellement v1.2.3-beta.4-linux-x86"
).split()


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big")


def made_examples(name: str, parts, n: int = MAX_EXAMPLES) -> list[str]:
    """Examples of a format; the k-th is always the same."""
    out = []
    for k in range(n):
        stream = b"".join(hashlib.sha256(f"{name}/{k}/{j}".encode()).digest() for j in range(8))
        at, word = 0, ""
        for text, length in parts:
            if length:
                word += "".join(text[b % len(text)] for b in stream[at : at + length])
                at += length
            else:
                word += text
        out.append(word)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost without overlap per kind."""
    spans = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(hint in folded for hint in _ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of strings that could be credentials, without dots and dashes at their ends."""
    out = []
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        start = m.start() + len(word) - len(word.lstrip("./-"))
        end = m.end() - len(word) + len(word.rstrip("./-"))
        if end - start >= 16:
            out.append((start, end))
    return out


def _shares(word: str) -> tuple[float, float, float]:
    """Shares of digits, lower-case and upper-case letters."""
    n = len(word)
    return sum(map(str.isdigit, word)) / n, sum(map(str.islower, word)) / n, sum(map(str.isupper, word)) / n


class Format:
    """The automaton of a format, and what its examples have in common.

    A merged state forgets how often it was visited, so length and shares of kinds of
    characters have to lie in the range of the examples, with some slack."""

    def __init__(self, examples: list[str]):
        self.automaton = ProbabilisticAutomaton(examples)
        self.least = min(self.automaton.log_likelihood(w) / (len(w) + 1) for w in examples) - SLACK
        lengths = [len(w) for w in examples]
        self.shortest, self.longest = 0.75 * min(lengths), 1.25 * max(lengths)
        shares = list(zip(*map(_shares, examples), strict=True))
        self.shares = [(min(s) - SLACK, max(s) + SLACK) for s in shares]
        #: What all examples begin with; long enough, it marks the begin of a secret inside a string.
        self.prefix = os.path.commonprefix(examples)

    def accepts(self, word: str) -> bool:
        return (
            self.shortest <= len(word) <= self.longest
            and all(low <= x <= high for x, (low, high) in zip(_shares(word), self.shares, strict=True))
            and self.automaton.log_likelihood(word) / (len(word) + 1) >= self.least
        )


class SecretModel:
    """Formats and the background of ordinary strings."""

    def __init__(self, labelled: dict[str, list[str]]):
        """``labelled``: strings by kind from the corpus; ``none`` has ordinary strings."""
        groups = {name: made_examples(name, parts) for name, parts in FORMATS}
        groups["access key id"] += labelled.get("access", [])
        if labelled.get("hex"):
            groups["hexadecimal"] = labelled["hex"]
        assigned = [w for w in labelled.get("assign", []) if len(w) >= 16]
        if assigned:
            groups["assigned"] = assigned
        self.formats: dict[str, Format] = {name: Format(examples) for name, examples in groups.items()}
        self.marked = [f for f in self.formats.values() if len(f.prefix) >= LEAST_PREFIX]
        self._pairs: Counter = Counter()
        self._firsts: Counter = Counter()
        self._singles: Counter = Counter()
        # Strings that a format would take are left out, or unlabelled secrets would pass for ordinary.
        none = [w for w in labelled.get("none", []) if not any(f.accepts(w) for f in self.formats.values())]
        for word in (*ORDINARY, *none):
            for a, b in zip("\n" + word, word, strict=False):
                self._pairs[a, b] += 1
                self._firsts[a] += 1
                self._singles[b] += 1
        self._total = sum(self._singles.values())

    def background(self, word: str) -> float:
        """Log-likelihood under character pairs of ordinary strings, smoothed by single characters."""
        total = 0.0
        for a, b in zip("\n" + word, word, strict=False):
            single = (self._singles[b] + 0.5) / (self._total + 34)
            total += math.log((self._pairs[a, b] + 5 * single) / (self._firsts[a] + 5))
        return total

    def judge(self, word: str) -> tuple[str, float] | None:
        """The best accepting format and its margin over the background, if large enough."""
        best = None
        for name, known in self.formats.items():
            if known.accepts(word):
                margin = known.automaton.log_likelihood(word) - self.background(word)
                if margin >= MARGIN and (best is None or margin > best[1]):
                    best = (name, margin)
        return best


def parts_of(word: str, model: SecretModel) -> list[tuple[int, int, str]]:
    """(start, end, format) of secrets inside a longer string, left to right without overlap.

    A part begins at the string's begin or behind one of ``JOINTS`` where a format's common
    beginning stands, and ends before a joint or at the string's end: the longest that is
    accepted. Its ends lie within the format's length, so the work is linear in the string."""
    joints = [i for i, c in enumerate(word) if c in JOINTS]
    out, upto = [], 0
    for start in [0, *[i + 1 for i in joints]]:
        known = [f for f in model.marked if start >= upto and word.startswith(f.prefix, start)]
        if not known:
            continue
        least, most = start + min(f.shortest for f in known), start + max(f.longest for f in known)
        for end in [e for e in (len(word), *reversed(joints)) if least <= e <= most]:
            found = model.judge(word[start:end])
            if found:
                out.append((start, end, found[0]))
                upto = end
                break
    return out


def find_spans(text: str, model: SecretModel) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, format) of base patterns and of accepted candidates, in order."""
    spans = [(kind, a, b, None) for kind, a, b in base_spans(text)]
    for a, b in candidates(text):
        found = model.judge(text[a:b])
        if found:
            spans.append(("format", a, b, found[0]))
        else:
            spans += [("format", a + i, a + j, name) for i, j, name in parts_of(text[a:b], model)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled_strings(docs: DataFrame, text: str = "text", most: int = MAX_EXAMPLES) -> dict[str, list[str]]:
    """Of each kind the ``most`` distinct strings with the smallest hash, from all texts.

    Every task hands over at most ``most`` strings a kind, so the driver gets a bounded
    sample whatever the corpus."""

    def run(batches):
        import pyarrow as pa

        least: dict[str, list[tuple[int, str]]] = {}
        kept: dict[str, set[str]] = {}

        def offer(kind, value):
            heap, have = least.setdefault(kind, []), kept.setdefault(kind, set())
            if value in have:
                return
            rank = -_hash(value)
            if len(heap) < most:
                heapq.heappush(heap, (rank, value))
                have.add(value)
            elif rank > heap[0][0]:
                have.discard(heapq.heapreplace(heap, (rank, value))[1])
                have.add(value)

        for batch in batches:
            for item in batch.column(0):
                whole = item.as_py()
                spans = base_spans(whole)
                for kind, a, b in spans:
                    offer(kind, _ASSIGN.match(whole, a).group(2) if kind == "assign" else whole[a:b])
                for a, b in candidates(whole):
                    if not any(s < b and a < e for _, s, e in spans):
                        offer("none", whole[a:b])
        rows = [(kind, -rank, value) for kind, heap in least.items() for rank, value in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([str(r[1]).zfill(20) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
            ["kind", "rank", "value"],
        )

    found = docs.select(docs[text].alias("_text")).where("_text is not null").mapInArrow(run, "kind string, rank string, value string")
    least = (
        found.groupBy("kind", "rank", "value")
        .agg(F.count("*"))
        .groupBy("kind")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "value"))), 1, most)["value"].alias("values"))
    )
    return {row["kind"]: list(row["values"]) for row in least.collect()}


def learn_secrets(docs: DataFrame, text: str = "text") -> SecretModel:
    return SecretModel(labelled_strings(docs, text))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,format:string>>"


def scan_secrets(docs: DataFrame, model: SecretModel, key: str = "doc_id", text: str = "text", replacement: str | None = None) -> DataFrame:
    """The key and ``spans`` (code points, end exclusive) of each row of ``docs``.

    With a ``replacement`` all columns of ``docs`` come back instead, their text with
    overlapping spans joined and replaced. Null or empty texts have no spans; a null text
    stays null. Repeated rows give repeated rows.
    """
    columns = docs.columns if replacement is not None else [key, text]
    at = columns.index(text)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("format", pa.string())]))
        for batch in chain.from_iterable(slices(whole, at) for whole in batches):
            values = batch.column(at).to_pylist()
            spans = [find_spans(v, model) if v else [] for v in values]
            if replacement is None:
                made = [[{"kind": k, "start": a, "end": b, "format": f} for k, a, b, f in row] for row in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], [key, "spans"])
            else:
                made = [redact(v, row, replacement) for v, row in zip(values, spans, strict=True)]
                arrays = [pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    if replacement is not None:
        return docs.mapInArrow(run, docs.schema)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}"
    return docs.select(key, text).mapInArrow(run, schema)


def redact(text: str | None, spans, replacement: str) -> str | None:
    """The text with each maximal run of spans replaced."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, None
    for _, a, b, _ in spans:
        if upto is not None and a <= upto:
            upto = max(upto, b)
            continue
        if upto is not None:
            at = upto
        out += [text[at:a], replacement]
        upto = b
    return "".join([*out, text[upto:]])


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts and digest of base spans, and all spans as text."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, learn_secrets(docs))
    order = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    line = "concat_ws(':', s.kind, s.start, s.end)"
    return found.selectExpr(
        "doc_id",
        f"transform(array_sort(transform(spans, s -> struct(s.start as start, {order} as o, s.end as end, s.kind as kind))), s -> struct(s.kind as kind, {line} as line)) as lines",
        "spans as found",
    ).selectExpr(
        "doc_id",
        *[f"bigint(size(filter(lines, s -> s.kind = '{k}'))) as n_{k}" for k in KINDS[:3]],
        "sha2(array_join(transform(filter(lines, s -> s.kind <> 'format'), s -> s.line), ','), 256) as base_sha256",
        "array_join(transform(lines, s -> s.line), ',') as spans",
        "bigint(size(filter(lines, s -> s.kind = 'format'))) as n_format",
        "found",
    )
