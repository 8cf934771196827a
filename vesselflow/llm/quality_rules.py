"""Quality rules whose limits follow the corpus: quantile sketches per language and source.

A page of code, a forum and a newspaper differ in what is normal, so a fixed limit is too
strict for one and too lax for the other. Here the measures of all documents that hold the
base rules are summarised by Spark's mergeable quantile summaries for each (language,
source), for each language, and for all. A small group says little about itself, so its
quantiles are drawn towards those of its language, and those of a small language towards
all, each by the weight of so many documents; no size switches the rule. A document fails
where it lies beyond a high (or low) quantile of its group by more than that quantile's own
distance from the median. No limit is a fixed share. The three levels come from one pass:
partial summaries are built beside the documents and only they are shuffled, so a source
with a third of all rows is no burden.

Columns only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm.common import stored, table, text_of

#: Documents that the language weighs in the quantiles of a group, and all in those of a language.
WEIGHT = 1000
#: Rank error of the summaries: one in so many documents.
ACCURACY = 10_000
#: The tail of a group that is looked at, and distances of its quantile from the median beyond
#: the quantile at which a document fails.
TAIL, REACH = 0.05, 1.0
#: Counts that a document may have beyond its limit, as one or two chance events are no
#: evidence: symbols, repeated lines, or words of two repeated windows. Per measure: what is
#: counted, per what, and this allowance; the length of words is a mean.
MEASURES = {
    "word_length": None,
    "symbols_per_word": ("n_symbols", "n_words", 2),
    "dup_line_share": ("n_dup_lines", "n_lines", 2),
    "repeat_word_share": ("n_repeat_words", "n_words", 10),
}
#: Measures that can also be too low.
TWO_SIDED = ("word_length",)
#: Rounding that decides nothing.
TINY = 1e-9
WINDOW = 5


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[ \t-\r]+", -1), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts without a repeat, most of them, end at the
    size of a set; the others sort (hash, place) and look at both neighbours.
    """
    n = F.size(words)
    windows = F.when(
        n > WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    )
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(pairs):
        def has_twin(x, j):
            after = F.get(pairs, j + 1)["h"].eqNullSafe(x["h"])
            before = (j > 0) & F.get(pairs, F.greatest(j - 1, F.lit(0)))["h"].eqNullSafe(x["h"])
            return after | before

        starts = F.array_sort(F.transform(F.filter(pairs, has_twin), lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(
                i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")
            ),
            lambda acc: acc["n"],
        )

    # A one-element array makes the sorted array a variable, so it is computed once.
    heavy = F.get(F.transform(F.array(ordered), count), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), heavy).otherwise(F.lit(0).cast("long"))


def text_measures(text: Column) -> dict[str, Column]:
    """Counts of one text; all zero for an empty one. Needs ``words`` beside it as a column."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    }


def with_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text is empty."""
    text = docs.select("doc_id", "lang", "source", text_of(docs).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    made = text_measures(F.col("_text"))
    counts = text.select("doc_id", "lang", "source", *[c.alias(n) for n, c in made.items()])
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*",
        (F.col("word_chars") / per_word).alias("word_length"),
        (F.col("n_symbols") / per_word).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / per_word).alias("repeat_word_share"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def _drawn(n: Column, own: Column, other: Column) -> Column:
    """Quantiles of a group, drawn towards those of the level above."""
    return F.zip_with(own, other, lambda x, y: (n * x + WEIGHT * y) / (n + WEIGHT))


def _bounds(q: Column) -> Column:
    high = q[2] + REACH * (q[2] - q[1])
    return F.struct((q[0] - REACH * (q[1] - q[0])).alias("low"), high.alias("high"))


def _upper_bound(q: Column) -> Column:
    return F.struct(F.lit(float("-inf")).alias("low"), (q[2] + REACH * (q[2] - q[1])).alias("high"))


def adaptive_limits(measured: DataFrame) -> DataFrame:
    """Lowest and highest accepted value of each measure, by language and source.

    Documents that fail the base rules are left out, as the limits are for the others.
    ``n`` counts those of a group; null languages and sources are groups like any other."""
    summaries = stored(
        measured.where("not base_failed and n_words > 0")
        .groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("n"),
            *[F.percentile_approx(m, [TAIL, 0.5, 1 - TAIL], ACCURACY).alias(m) for m in MEASURES],
        ),
        "quantiles",
    )
    # One row per group: the three levels are told apart by the grouping, so nulls are groups.
    packed = F.struct(*MEASURES)
    groups = summaries.where("level = 0").select("lang", "source", "n", packed.alias("own"))
    languages = summaries.where("level = 1").select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), packed.alias("of_lang"))
    single = summaries.where("level = 3").first()  # one row of few numbers, none for an empty table
    whole = single.asDict() if single else {}
    joined = groups.join(languages, F.col("lang").eqNullSafe(F.col("_lang")))
    limits = []
    for name in MEASURES:
        of_all = F.array(*[F.lit(q) for q in whole.get(name) or [None] * 3]).cast("array<double>")
        above = _drawn(F.col("_n"), F.col(f"of_lang.{name}"), of_all)
        drawn = _drawn(F.col("n"), F.col(f"own.{name}"), above)
        # A one-element array makes the quantiles a variable, so they are computed once.
        made = F.transform(F.array(drawn), _bounds if name in TWO_SIDED else _upper_bound)
        limits.append(F.get(made, F.lit(0)).alias(name))
    return joined.select("lang", "source", "n", F.struct(*limits).alias("limits"))


def apply_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: the base rules hold and no measure is beyond the limits of its group.

    Limits are joined by language and source; their table has a row per group and is never
    collected. A group without limits has no document that holds the base rules."""
    of_group = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("limits").alias("_limits"))
    joined = measured.join(of_group, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fails = F.lit(False)
    for name, counted in MEASURES.items():
        low, high = F.col(f"_limits.{name}.low"), F.col(f"_limits.{name}.high")
        chance = F.lit(0.0) if counted is None else counted[2] / F.greatest(F.col(counted[1]), F.lit(1))
        fails = fails | (F.col(name) > high + chance + TINY) | (F.col(name) < low - TINY)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(fails, F.lit(False))).drop("_lang", "_source", "_limits")


def judge_quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document; the measures are stored once and used twice.

    A null text is empty: it fails the base rules. Repeated rows count each and get the same
    verdict, equal values have equal verdicts, an empty table has no rows. Only ``doc_id``,
    ``text``, ``lang`` and ``source`` are read, so other columns cannot clash."""
    measured = stored(with_measures(docs), "quality")
    return apply_limits(measured, adaptive_limits(measured))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, the base verdict and the adaptive one."""
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quantile_sql(level: str, keys: str) -> str:
    """Quantiles by rank: the first value with at least its share of the values up to it."""
    made = ", ".join(f"[quantile_disc({m}, {TAIL}), quantile_disc({m}, 0.5), quantile_disc({m}, {1 - TAIL})] AS {m}" for m in MEASURES)
    grouped = f"{keys}, " if keys else ""
    return f"{level} AS (SELECT {grouped}count(*) AS n, {made} FROM measured WHERE NOT base_failed AND n_words > 0{f' GROUP BY {keys}' if keys else ''})"


def _limits_sql() -> str:
    columns = []
    for name in MEASURES:
        above = f"(l.n * l.{name}[k] + {WEIGHT} * a.{name}[k]) / (l.n + {WEIGHT})"
        columns.append(f"[(g.n * g.{name}[k] + {WEIGHT} * {above}) / (g.n + {WEIGHT}) for k in [1, 2, 3]] AS {name}")
    return f"""limits AS (SELECT g.lang, g.source, {", ".join(columns)}
  FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN by_all a)"""


def _fails_sql() -> str:
    tests = []
    for name, counted in MEASURES.items():
        chance = "0.0" if counted is None else f"{counted[2]} / greatest(m.{counted[1]}, 1)"
        q = f"l.{name}"
        tests.append(f"m.{name} > {q}[3] + {REACH} * ({q}[3] - {q}[2]) + {chance} + {TINY}")
        if name in TWO_SIDED:
            tests.append(f"m.{name} < {q}[1] - {REACH} * ({q}[2] - {q}[1]) - {TINY}")
    return " OR ".join(tests)


#: The same results with joins and sorted windows of words.
SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM texts),
windows AS (
  SELECT row, unnest([array_to_string(words[i : i + {WINDOW - 1}], ' ') for i in range(1, len(words) - {WINDOW - 2})]) AS five,
    unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split WHERE len(words) >= {WINDOW}),
same AS (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS copies FROM windows),
repeats AS (
  SELECT row, count(DISTINCT i + k) AS n FROM same, (SELECT unnest(range({WINDOW})) AS k) WHERE copies > 1 GROUP BY row),
counted AS (
  SELECT s.*, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(w) for w in words]), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON r.row = s.row),
measured AS (
  SELECT *, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_word_share,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
{_quantile_sql("by_group", "lang, source")},
{_quantile_sql("by_lang", "lang")},
{_quantile_sql("by_all", "")},
{_limits_sql()}
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
  NOT m.base_failed AND NOT coalesce({_fails_sql()}, false) AS kept
FROM measured m LEFT JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""
