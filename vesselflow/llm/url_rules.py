"""URL filters: host-suffix and path-prefix expressions against a table of hashed rules.

Every URL is expanded into the expressions that a rule could name: each suffix of its host
with each prefix of its path. Expressions meet rules by an equi-join on a short prefix of
their SHA-256, as a shared block list would be sent around; the full digest then confirms
the hit, and the longest rule of a URL decides.

Columns only: no Python runs on the executors. The expansion never leaves its task: hits
are reduced to one candidate per row before the shuffle, so neither a host with a third
of all rows nor a rule that fits them all makes a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm.common import ascii_lower

#: Hexadecimal digits of the digest that the join uses: four bytes.
PREFIX_DIGITS = 8
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case.

    Null, or a URL without ``://``, has the empty host."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty as the host is."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows (host, path, verdict)."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules with their digest; a rule stated twice counts once, and ``block`` wins over ``allow``.

    Rows with a null are no rules. The last columns tell how rules end, for the expansion."""
    text = F.concat("host", "path")
    return (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .where("host is not null and path is not null and verdict is not null and host <> ''")
        .groupBy("host", "path")
        .agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
        .select(
            text.alias("rule"),
            "verdict",
            F.sha2(text, 256).alias("digest"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            F.length("path").alias("path_length"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def expressions(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """All host suffixes of at most ``labels`` labels with all path prefixes of the given lengths.

    No rule has more labels or another length, so no other expression can meet one. A path
    prefix ends anywhere, as "starts with" asks for."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, labels)),
        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda k: k <= F.length(path)),
        lambda k: F.substring(path, F.lit(1), k),
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def apply_url_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the rule that decided and the verdict.

    One row for each row of ``pages``, repeated rows and null ids included. Ties cannot
    occur: two rules of equal length that fit one URL would have equal host and path, or
    else differ in where the host ends; then the longer host wins. Without rules every
    row has the default verdict. Columns of ``pages`` of the same names are replaced.
    """
    compiled = compile_rules(rules)
    # Two numbers and at most as many lengths as the longest path has characters.
    bounds = compiled.agg(F.max("labels").alias("labels"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c not in made]
    parsed = pages.select(
        *kept, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path")
    )
    if not bounds["labels"]:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    row = F.struct(*[F.col(c) for c in parsed.columns])
    numbered = parsed.select(F.monotonically_increasing_id().alias("_row"), row.alias("_page"), "host", "path")
    expanded = numbered.select(
        "_row",
        "_page",
        F.explode_outer(
            expressions(
                F.col("host"),
                F.col("path"),
                F.lit(bounds["labels"]),
                F.array(*[F.lit(k) for k in bounds["lengths"]]),
            )
        ).alias("_expression"),
    ).withColumn("_digest", F.sha2("_expression", 256))
    hits = expanded.join(
        compiled.select(
            F.col("prefix").alias("_prefix"),
            F.col("digest").alias("_rule_digest"),
            F.struct(F.length("rule").alias("n"), (F.length("rule") - F.col("path_length")).alias("h"), "rule", "verdict").alias("_hit"),
        ),
        (F.substring("_digest", 1, PREFIX_DIGITS) == F.col("_prefix")) & (F.col("_digest") == F.col("_rule_digest")),
        "left",
    )
    best = hits.groupBy("_row").agg(F.first("_page").alias("_page"), F.max("_hit").alias("_hit"))
    return best.select(
        "_page.*", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict")
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, rule and verdict under the fixed rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = apply_url_rules(pages, rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with parsed as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    row_number() over () as r
  from pages),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits as (
  select r, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc, length(h) desc) as k
  from parsed join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict
from parsed left join hits on parsed.r = hits.r and k = 1
"""
