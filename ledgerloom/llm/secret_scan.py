"""Secrets by patterns and by the entropy of what looks like none of the language.

Everything is native column expressions over one row's whole text; nothing is
shuffled. Three patterns give spans of fixed kinds. A fourth kind comes from
entropy: candidate strings, runs of characters that keys are made of, are put
into a class by the characters that they use, and a window slides over each.
The window's Shannon entropy follows from how often each character stands in
it: a step counts one character up and one down, and changes the sum of
c log c by those two. Entropies are compared as whole millionths of a bit, so
they come out alike on every machine. An allow list drops candidates that are
known to be no secrets: examples, identifiers in a public form, words and
numbers joined by separators.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, text_of

#: Kinds of spans in order, and what the fixed patterns need.
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 12
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run can't hold a longer one, so these lengths may stand in the patterns.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Characters of a window, which are also the least of a candidate.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Of the candidates' characters "+" has the lowest code and "z" the highest.
FIRST_CODE, CODES = ord("+"), ord("z") - ord("+") + 1
MICRO = 1_000_000


@dataclass(frozen=True)
class Class:
    """Candidates of the characters in pattern; bits: the entropy from which a window is suspicious."""

    pattern: str
    bits: float

    @property
    def most(self) -> int:
        """What the sum of c log c in a window may come to, in millionths."""
        return math.floor(MICRO * WINDOW * (math.log2(WINDOW) - self.bits))


#: The first class that a candidate fits counts.
CLASSES = (Class("^[0-9a-fA-F]+$", 3.2), Class("^[A-Z0-9]+$", 3.5), Class("^[A-Za-z0-9+/_=-]+$", 3.9))
#: c log c for each count in a window, in millionths of a bit.
C_LOG_C = tuple(round(MICRO * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1))
#: Candidates that no class makes secrets.
ALLOWED = (
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Rr][Ee][Dd][Aa][Cc][Tt][Ee][Dd]|[Xx]{4}",
    "[Aa][Bb][Cc][Dd][Ee][Ff][Gg]|01234567|12345678",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[+/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*$",
)
SPAN, FOUND = "array<struct<start:int,kind:int,end:int>>", "array<struct<start:int,end:int,match:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def running_sums(numbers: Column) -> Column:
    """The sum up to each number, by doubling steps, so an array is copied some log n times and not for each number."""
    double = lambda a, k: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    steps = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), steps), numbers, lambda a, k: double(a, k.cast("int")))


def located(text: Column, pattern: str) -> Column:
    """start, end (exclusive) and match of the leftmost matches that don't overlap, in code points. What stands between matches tells where they are."""

    def places(matches: Column) -> Column:
        lengths = _let(F.split(text, pattern, -1), lambda gaps: F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return _let(running_sums(lengths), lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"))))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(_none(FOUND))


def _as_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def most_of(token: Column, classes: tuple[Class, ...]) -> Column:
    """The bound of the first class that token fits; null without one."""
    out = F.when(token.rlike(classes[0].pattern), F.lit(classes[0].most))
    for c in classes[1:]:
        out = out.when(token.rlike(c.pattern), F.lit(c.most))
    return out.cast("long")


def suspicious_runs(token: Column, most: Column) -> Column:
    """start and end in token of what windows with a sum of most or less cover; windows that touch become one."""
    table_ = F.array(*[F.lit(x).cast("long") for x in C_LOG_C])
    term = lambda c: F.get(table_, c)
    begin = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0).cast("long").alias("sum"), _none("array<struct<start:int,end:int>>").alias("runs"))

    def runs_with(runs: Column, end: Column) -> Column:
        start, last = end - WINDOW, F.get(runs, F.size(runs) - 1)
        touching = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.when((F.size(runs) > 0) & (last["end"] >= start), touching).otherwise(F.concat(runs, F.array(F.struct(start.alias("start"), end.alias("end")))))

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            comes, goes = F.get(codes, i), F.get(codes, i - WINDOW)
            lost, before = F.get(state["counts"], goes), F.get(state["counts"], comes) - F.when(comes == goes, 1).otherwise(0)
            sum_ = state["sum"] + F.coalesce(term(lost - 1) - term(lost), F.lit(0)) + term(before + 1) - term(before)
            counts = F.transform(state["counts"], lambda c, j: c + F.when(j == comes, 1).otherwise(0) - F.when(j == goes, 1).otherwise(0))
            runs = F.when((i >= WINDOW - 1) & (sum_ <= most), runs_with(state["runs"], i + 1)).otherwise(state["runs"])
            return F.struct(counts.alias("counts"), sum_.alias("sum"), runs.alias("runs"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda state: state["runs"])

    return _let(F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST_CODE), slide)


def entropy_spans(text: Column, base: Column, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of the kind entropy: of letters and digits both, not on the allow list, and apart from the spans in base."""
    least_distinct = math.ceil(2 ** min(c.bits for c in classes))  # a window of fewer characters can't have the entropy

    def worth_it(m: Column) -> Column:
        token = m["match"]
        fit = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(token, ""))) >= least_distinct)
        for pattern in allowed:
            fit = fit & ~token.rlike(pattern)
        return fit

    def spans(m: Column) -> Column:
        inside = suspicious_runs(m["match"], most_of(m["match"], classes))
        return F.transform(inside, lambda r: F.struct((m["start"] + r["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (m["start"] + r["end"]).alias("end")))

    found = F.flatten(F.transform(F.filter(located(text, CANDIDATE), worth_it), spans))
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, assign, access, hex and entropy of each row of docs: arrays of spans (start, kind, end), in order.

    A null text is the empty one and has no spans. Rows are looked at one by
    one, so repeated rows and null ids come out as they went in, whatever
    other columns there are; an empty table gives no rows.
    """
    text = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select(
        "doc_id", "text", _as_kind(F.filter(located(text, ASSIGN), value), "assign").alias("assign"), _as_kind(located(text, ACCESS), "access").alias("access"), _as_kind(located(text, HEX), "hex").alias("hex")
    )
    return rows.select("doc_id", "assign", "access", "hex", entropy_spans(text, F.concat("assign", "access", "hex"), classes, allowed).alias("entropy"))


def listed(*spans: str) -> Column:
    """Spans as kind:start:end by start, then kind, joined by commas."""
    name = lambda kind: F.get(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.array_join(F.transform(F.array_sort(F.concat(*spans)), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return rows.select("doc_id", *[size(k) for k in KINDS], F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found_sql(kind: str, pattern: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(t, {_quoted(pattern)})) AS match, unnest(regexp_split_to_array(t, {_quoted(pattern)})) AS gap, unnest(range(len(regexp_split_to_array(t, {_quoted(pattern)})))) AS i FROM d WHERE regexp_matches(t, {_quoted(pattern)})"


_CLASS = " ".join(f"WHEN regexp_matches(match, {_quoted(c.pattern)}) THEN {c.most}" for c in CLASSES)
_NOT_ALLOWED = " AND ".join(f"NOT regexp_matches(match, {_quoted(p)})" for p in ALLOWED)
_LIST = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found_sql(k, p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE)))}),
placed AS (SELECT doc_id, kind, match, cast(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS bigint) AS b FROM found WHERE match IS NOT NULL),
base AS (SELECT doc_id, kind, b - length(match) AS a, b FROM placed WHERE kind <> 'candidate' AND (kind <> 'assign' OR length(regexp_extract(match, {_quoted(ASSIGN)}, 2)) >= {LEAST_VALUE})),
tokens AS (SELECT doc_id, match, b - length(match) AS a, CASE {_CLASS} END AS most FROM placed WHERE kind = 'candidate' AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND {_NOT_ALLOWED}),
slides AS (SELECT doc_id, match, a, most, unnest(range(length(match) - {WINDOW - 1})) AS k FROM tokens),
letters AS (SELECT doc_id, match, a, most, k, unnest(string_split(substr(match, k + 1, {WINDOW}), '')) AS c FROM slides),
counted AS (SELECT doc_id, match, a, most, k, c, count(*) AS n FROM letters GROUP BY ALL),
high AS (SELECT doc_id, a, k FROM counted GROUP BY doc_id, match, a, most, k HAVING sum([{", ".join(map(str, C_LOG_C))}][n + 1]) <= most),
steps AS (SELECT *, CASE WHEN k - lag(k) OVER w <= {WINDOW} THEN 0 ELSE 1 END AS new FROM high WINDOW w AS (PARTITION BY doc_id, a ORDER BY k)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, a ORDER BY k) AS run FROM steps),
entropy AS (SELECT doc_id, 'entropy' AS kind, a + min(k) AS a, a + max(k) + {WINDOW} AS b FROM runs GROUP BY doc_id, runs.a, run),
apart AS (SELECT * FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = e.doc_id AND s.a < e.b AND e.a < s.b)),
spans AS (SELECT *, list_position([{", ".join(f"'{k}'" for k in KINDS)}], kind) AS k FROM (SELECT * FROM base UNION ALL SELECT * FROM apart))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, sha256({_LIST} FILTER (k <= 3), '')) AS base_sha256, {_LIST} FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
