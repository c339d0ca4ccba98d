import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as M

SCHEMA = "doc_id long, text string, n_words string, kept string"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    seen = {}
    for i in range(n - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeat = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})
    dup = len(lines) - len(set(lines))
    base = n < 50 or 100 * repeat > 50 * n
    bad = symbols * 100 > n * 30 or chars < 2 * n or chars > 15 * n or dup * 100 > len(lines) * 30 or len(re.findall("[A-Z]", text)) * 100 > chars * 50
    bad |= sum(c.isalpha() for c in text) * 100 < chars * 50 or sum(x.endswith("!!") for x in w) * 100 > n * 30 or len(set(w)) * 100 < n * 5
    return n, chars, symbols, dup, repeat, base, not base and not bad


def test_against_plain_version(spark):
    rng = random.Random(1)
    words = ["a", "the", "Word", "LOUD", "x#", "é", "42", "wow!!", "|", "longer", "\n", "\n", "\t"]
    texts = ["".join(rng.choice(words) + rng.choice(" \n") for _ in range(rng.choice([0, 10, 49, 60, 120]))) for _ in range(120)]
    texts += [" ".join(f"word{i}" for i in range(80)), "same line\n" * 40, None, "", " \n", "x" * 100_000, " ".join(f"w{i % 7000}" for i in range(20_000))]
    texts += [f"{' '.join(f'tok{rng.randrange(900)}' for _ in range(70))}" for _ in range(20)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, texts[0], "", ""), (None, texts[1], "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = M.judge(frame.select("doc_id", "text")).select("doc_id", *columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain(t)) for i, t, *_ in rows], key=str)
    good = M.select_good(frame)
    assert good.columns == frame.columns and sorted(map(tuple, good.collect()), key=str) == sorted([r for r in rows if plain(r[1])[-1]], key=str)
    assert M.judge(frame.limit(0)).count() == 0


def test_order_is_by_rejections_per_second():
    rules = [M.Rule(n, lambda s: F.lit(False)) for n in "abc"]
    measured = [(rules[0], 1.0, 0.5), (rules[1], 0.1, 0.2), (rules[2], 2.0, 0.0)]
    assert [r.name for r, *_ in sorted(measured, key=M.worth)] == ["b", "a", "c"]


@pytest.mark.parametrize("source", ["json", "renamed", "filtered"])
def test_any_frame_can_be_judged(spark, tmp_path, source):
    rows = [(i, " ".join(f"word{j}" for j in range(60)) if i % 2 else "short", "a", "b") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.json(str(tmp_path / "j"))
    frame.withColumnRenamed("text", "body").write.parquet(str(tmp_path / "p"))
    read = {"json": lambda: spark.read.schema(SCHEMA).json(str(tmp_path / "j")), "renamed": lambda: spark.read.parquet(str(tmp_path / "p")).withColumnRenamed("body", "text"), "filtered": lambda: frame.where("doc_id % 2 = 1")}[source]()
    assert sorted(r.doc_id for r in M.select_good(read).collect()) == list(range(1, 40, 2))


def test_costly_statistics_count_for_their_rule(spark):
    text = " ".join(f"w{j % 700}" for j in range(3000))
    frame = spark.createDataFrame([(i, text, "", "") for i in range(300)], SCHEMA)
    cost = {rule.name: seconds for rule, seconds, _ in M.measure(frame, [*M.BASE_RULES, *M.default_rules()])}
    assert cost["repeated_words"] > 3 * cost["few_words"]
