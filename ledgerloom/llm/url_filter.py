"""URL rules by a bit-parallel automaton for glob patterns.

All patterns of a rule set lie side by side in one row of 64-bit words, a
bit for each character position. One Shift-And step moves every pattern on by
the same character: shift the row, let positions that are a star keep or pass
on their bit, and mask with the row of that character. A batch of URLs is
simulated together, a character column at a time, so a step is a few numpy
operations on (URLs x words), whatever the number of patterns.

A canonical URL is "." + host + NUL + path. "*" stands for any characters
but NUL and "?" for one, so a star in the host cannot run on into the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, table

NUL = "\0"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs that are simulated together.
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of the path."""

    text: str
    verdict: str

    @property
    def glob(self) -> str:
        host, slash, path = self.text.partition("/")
        return f"*.{host}{NUL}{slash}{path}*"


HOST_RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: What no host rule decides is blocked if it looks like a tracker, an advert server or a page without an article.
BLOCK_GLOBS = (
    f"*.doubleclick.*{NUL}*", f"*.ads.*{NUL}*", f"*.adserver.*{NUL}*", f"*.tracker.*{NUL}*", f"*{NUL}*/wp-login*", f"*{NUL}*/cgi-bin/*", f"*{NUL}*/login", f"*{NUL}*/login/*",
)


class Automaton:
    def __init__(self, globs: list[str]):
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for g in globs for c in g} - {"*", "?"} | {NUL}))}
        n_words = -(-max(1, sum(len(g) + 1 for g in globs)) // 64)
        row = lambda: np.zeros(n_words, np.uint64)
        self.start, self.stars, self.accept, bit = row(), row(), [], 0
        self.masks = np.zeros((len(self.alphabet) + 1, n_words), np.uint64)
        for glob in globs:
            set_bit = lambda x, k: x.__setitem__(k // 64, x[k // 64] | np.uint64(1 << k % 64))
            set_bit(self.start, bit)  # bit k: the first k characters of the pattern are matched
            for k, c in enumerate(glob):
                if c == "*":
                    set_bit(self.stars, bit + k)
                else:
                    for i in range(len(self.masks)) if c == "?" else [self.alphabet[c]]:
                        if not (c == "?" and i == self.alphabet[NUL]):
                            set_bit(self.masks[i], bit + k)
            self.accept.append(bit + len(glob))
            bit += len(glob) + 1

    @staticmethod
    def _shift(x: np.ndarray) -> np.ndarray:
        out = x << np.uint64(1)
        out[:, 1:] |= x[:, :-1] >> np.uint64(63)
        return out

    def _pass_stars(self, x: np.ndarray) -> np.ndarray:
        """A pattern that stands before a star may stand after it too."""
        while True:
            more = x | self._shift(x & self.stars)
            if (more == x).all():
                return x
            x = more

    def matches(self, texts: list[str]) -> np.ndarray:
        """URLs x patterns: whether the pattern matches the whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        codes = [np.fromiter((self.alphabet.get(c, 0) for c in texts[i]), np.int16, len(texts[i])) for i in order]
        lengths = np.array([len(c) for c in codes], np.int64)
        state = self._pass_stars(np.tile(self.start, (len(texts), 1)))
        nul = self.alphabet[NUL]
        for at in range(lengths[0] if len(codes) else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))  # the texts are in order of length, so the live ones come first
            char = np.fromiter((c[at] for c in codes[:live]), np.int16, live)
            now = state[:live]
            stay = np.where((char == nul)[:, None], np.uint64(0), now & self.stars)
            state[:live] = self._pass_stars(self._shift(now & self.masks[char]) | stay)
        accept = np.array(self.accept, np.int64)
        found = (state[:, accept // 64] >> (accept % 64).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((len(texts), len(accept)), bool)
        out[order] = found.astype(bool)
        return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule and verdict for each row, without a shuffle.

    The longest rule that fits gives rule and verdict. Where none fits, rule
    is null and the verdict is block if one of block_globs fits, else allow.
    Null urls and urls without :// have an empty host and path; only globs
    can fit those. Rows are judged on their own: repeated rows and null ids
    come out as they went in, whatever other columns there are. An empty
    table gives no rows.
    """
    small_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.text))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([*(r.glob for r in ranked), *block_globs])
        for hosts, paths in batches:
            texts = [f".{h.replace(NUL, chr(0xFFFD))}{NUL}{p.replace(NUL, chr(0xFFFD))}" for h, p in zip(hosts, paths, strict=True)]
            out = []
            for i in range(0, len(texts), BLOCK):
                for row in automaton.matches(texts[i : i + BLOCK]):
                    best = next((r for r, hit in zip(ranked, row, strict=False) if hit), None)
                    out.append((best.text, best.verdict) if best else (None, "block" if row[len(ranked) :].any() else "allow"))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    verdict = F.pandas_udf(judge, "rule string, verdict string")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.select("*", verdict("host", "path").alias("v")).select("page_id", "host", "path", "v.rule", "v.verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), f AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
  WHEN regexp_matches('.' || host, '\.(doubleclick|ads|adserver|tracker)\.') OR path LIKE '%/wp-login%' OR path LIKE '%/cgi-bin/%' OR path LIKE '%/login' OR path LIKE '%/login/%'
  THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
