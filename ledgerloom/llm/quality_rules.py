"""Quality rules as a short-circuit cascade of native column expressions.

A rule looks at statistics of one whole text. ``measure`` estimates on a
bounded sample what each rule costs, with the statistics that it alone needs,
and how many rows it rejects; ``cascade`` puts the rules in order of
rejections per second. The cascade is one CASE: a rule's statistics are part
of its branch, so they are computed only for rows that the rules before it let
pass. The order changes the work, never the verdict.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, forget, keep, table, text_of

#: Rows of the sample that costs and selectivities are estimated on, characters of their texts that count for it, and runs of which the fastest counts.
SAMPLE_ROWS, SAMPLE_CHARS, RUNS = 1000, 20_000, 2
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: How a rule gets a statistic: by its name.
Statistics = Callable[[str], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _n_repeat_words(words: Column) -> Column:
    """Words in windows of three that come twice or more."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def repeats(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))  # equal windows become neighbours

        def count(r: Column) -> Column:
            last = F.size(r) - 1
            twin = lambda j, k: F.get(r, j)["h"] == F.get(r, k)["h"]
            shared = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & twin(j, j - 1)) | ((j < last) & twin(j, j + 1)))
            inside = F.flatten(F.transform(shared, lambda j: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get(r, j)["i"] + k)))
            return F.size(F.array_distinct(inside))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ranked, count))

    return F.when(F.size(words) >= 3, _let(hashed, repeats)).otherwise(F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def statistic(name: str) -> Column:
    """A statistic as an expression over the columns of ``worded``."""
    text, words = F.col("text"), F.col("words")
    makers: dict[str, Callable[[], Column]] = {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": lambda: F.length(text).cast("long") - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": lambda: F.size(_lines(text)).cast("long"),
        "n_dup_lines": lambda: _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": lambda: _n_repeat_words(words),
        "capitals": lambda: F.regexp_count(text, F.lit("[A-Z]")),
        "letters": lambda: F.regexp_count(text, F.lit(r"\p{L}")),
        "shouted": lambda: F.regexp_count(text, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")),
        "vocabulary": lambda: F.size(F.array_distinct(words)),
    }
    return makers[name]()


@dataclass(frozen=True)
class Rule:
    """reject: given the statistics, true for a text that the rule rejects."""

    name: str
    reject: Callable[[Statistics], Column]


BASE_RULES = (
    Rule("few_words", lambda s: s("n_words") < 50),
    Rule("repeated_words", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
)


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", lambda s: s("n_symbols") * 100 > s("n_words") * 30),
        Rule("word_length", lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 15 * s("n_words"))),
        Rule("repeated_lines", lambda s: s("n_dup_lines") * 100 > s("n_lines") * 30),
        Rule("capitals", lambda s: s("capitals") * 100 > s("word_chars") * 50),
        Rule("few_letters", lambda s: s("letters") * 100 < s("word_chars") * 50),
        Rule("shouted_words", lambda s: s("shouted") * 100 > s("n_words") * 30),
        Rule("poor_vocabulary", lambda s: s("vocabulary") * 100 < s("n_words") * 5),
    ]


def worded(docs: DataFrame) -> DataFrame:
    """docs with text (never null) and words, on which all statistics build."""
    return docs.withColumn("text", text_of()).withColumn("words", F.array_remove(F.split("text", SPACE), ""))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """Some rows of docs as they are, whatever they come from; Spark stops at the first partitions that have enough. It stays in the JVM."""
    spark = docs.sparkSession
    some = docs.select(F.left(text_of(), F.lit(SAMPLE_CHARS)).alias("text")).limit(rows)
    return keep(worded(DataFrame(spark._jsparkSession.createDataFrame(some._jdf.collectAsList(), some._jdf.schema()), spark)).coalesce(1))


def measure(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds beyond those of reading the rows, and the share of rows that it rejects, on a sample."""
    sample = _sample(docs, rows)

    def run(reject: Column) -> tuple[float, float]:
        seconds = []
        for _ in range(RUNS):
            began = time.perf_counter()
            n, rejected = sample.agg(F.count(F.lit(1)), F.count_if(reject)).first()
            seconds.append(time.perf_counter() - began)
        return min(seconds), rejected / max(1, n)

    reading = run((F.length("text") < 0) & (F.size("words") < 0))[0]
    out = [(rule, max(1e-3, seconds - reading), share) for rule in rules for seconds, share in (run(rule.reject(statistic)),)]
    forget(sample)
    return out


def worth(measured: tuple[Rule, float, float]) -> float:
    """Sorts rules by rejections per second, the most first."""
    _, seconds, share = measured
    return -share / seconds


def cascade(measured: list[tuple[Rule, float, float]], statistics: Statistics = statistic) -> Column:
    """The name of the first rule that rejects a row, or null; most rejections per second come first."""
    ordered = [rule for rule, *_ in sorted(measured, key=worth)]
    chain = F.when(ordered[0].reject(statistics), ordered[0].name) if ordered else F.lit(None).cast("string")
    for rule in ordered[1:]:
        chain = chain.when(rule.reject(statistics), rule.name)
    return chain


#: The statistics that a judged row shows.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the statistics in SHOWN, base_failed, kept and rejected_by; nothing is shuffled and no row is dropped.

    Null texts equal the empty text, which has no words, fails the base rule
    and isn't kept. Each row is judged on its own, so ties, repeated rows and
    null ids need no rule. An empty table gives no rows. Columns of docs that
    are named like one of those given here, or ``words``, are replaced;
    ``select_good`` keeps all columns as they are.
    """
    rules = default_rules() if rules is None else rules
    shown = lambda name: F.col(name) if name in SHOWN else statistic(name)
    first = cascade(measure(docs, rules, sample_rows), shown)
    judged = worded(docs).withColumns({name: statistic(name) for name in SHOWN}).withColumn("base_failed", functools.reduce(Column.__or__, [r.reject(shown) for r in BASE_RULES]))
    return judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(first)).withColumn("kept", F.col("rejected_by").isNull())


def select_good(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are, whatever their names. The base rules are part of the cascade here, as nobody asks for statistics."""
    rules = [*BASE_RULES, *(default_rules() if rules is None else rules)]
    rows = worded(docs.select(F.struct("*").alias("row"), "text"))
    # Catalyst would push the filter below the words, and split them once for each rule; a row number holds it back.
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    return numbered.where((F.col("number") >= 0) & cascade(measure(docs, rules, sample_rows)).isNull()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), s AS (
  SELECT *, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters,
         len(list_filter(w, lambda x: suffix(x, '!!'))) AS shouted
  FROM d
), p AS (
  SELECT doc_id, unnest(list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x, unnest(range(1, n_words - 1)) AS i
  FROM s
), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
f AS (
  SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM s LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > n_words * 30 OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_dup_lines * 100 > n_lines * 30 OR capitals * 100 > word_chars * 50 OR letters * 100 < word_chars * 50
            OR shouted * 100 > n_words * 30 OR len(list_distinct(w)) * 100 < n_words * 5) AS kept
FROM f
"""
