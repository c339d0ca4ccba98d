import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import secret_scan as M

SCHEMA = "doc_id long, text string, spans string, assign string, n_hex string"
WORD = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    out = [(m.start(), 0, m.end()) for m in WORD.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def entropy(text, taken):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        token = m[0]
        if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)) or any(re.search(p, token) for p in M.ALLOWED):
            continue
        bits = next(c.bits for c in M.CLASSES if re.search(c.pattern, token))
        runs = []
        for i in range(len(token) - 19):
            counts = Counter(token[i : i + 20]).values()
            if -sum(c / 20 * math.log2(c / 20) for c in counts) < bits:
                continue
            if runs and runs[-1][1] >= i:
                runs[-1][1] = i + 20
            else:
                runs.append([i, i + 20])
        out += [(m.start() + a, 3, m.start() + b) for a, b in runs]
    return [x for x in out if not any(s < x[2] and x[0] < e for s, _, e in taken)]


def plain(doc_id, text):
    spans = base(text or "")
    name = lambda xs: ",".join(f"{M.KINDS[k]}:{a}:{b}" for a, k, b in xs)
    everything = sorted(spans + entropy(text or "", spans))
    return (doc_id, *[sum(k == i for _, k, _ in everything) for i in range(4)], hashlib.sha256(name(spans).encode()).hexdigest(), name(everything))


def texts():
    rng = random.Random(11)
    any_of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed, upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    parts = [
        lambda: any_of(mixed, rng.choice([12, 20, 40, 90])), lambda: "AKIA" + any_of(upper, rng.choice([0, 5, 13, 14, 16])), lambda: any_of(hexa, rng.choice([15, 16, 40])), lambda: any_of(hexa.upper(), 32),
        lambda: rng.choice(["password", "ToKeN", "API_KEY", "apikey", "passwd", "secreT", "ſecret", "toKen"]) + rng.choice(['="', "': '", "=", ": ", " = ", "==", '"'] ) + any_of(mixed + "._", rng.choice([3, 11, 12, 30])),
        lambda: "some-long-article-about-2024-and-more", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "EXAMPLEKEY" + any_of(mixed, 20), lambda: "internationalisation", lambda: "é\U0001f600", lambda: "aaaa" * rng.choice([1, 9]) + any_of(mixed, 22) + "b1" * 15,
    ]
    out = [rng.choice(["", " ", "\n"]).join(rng.choice(parts)() for _ in range(rng.choice([0, 1, 3, 8]))) for _ in range(150)]
    out += ["token=secret:abcdefghijkl", "token=abc secret=abcdefghijkl1", "AKIAKIA" + "A" * 12, None, "", " ", "x" * 60_000 + any_of(mixed, 40), (any_of(mixed, 24) + " ") * 1500, any_of(mixed, 6000)]
    return out


def test_against_plain_version(spark, tmp_path):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts())]
    rows += [rows[3], (None, rows[5][1], None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, M.op11_secret_scan(spark, str(tmp_path)).collect()), key=str)
    want = sorted([plain(r[0], r[1]) for r in rows], key=str)
    assert got == want
    assert [sum(w[k] for w in want) > 5 for k in (1, 2, 3, 4)] == [True] * 4


def test_empty_table(spark):
    assert M.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_sums(spark):
    got = spark.range(40).select(F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id").cast("int"))).otherwise(F.array().cast("array<int>")).alias("a")).select(M.running_sums(F.col("a")).alias("s")).collect()
    assert sorted(len(r.s) for r in got) == list(range(40)) and all(r.s == [i * (i + 1) // 2 for i in range(1, len(r.s) + 1)] for r in got)


def test_no_python(spark):
    plan = M.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_own_classes_and_allow_list(spark):
    docs = spark.createDataFrame([(1, "key ZXCVBNMASDFGHJKLQWE1 end")], "doc_id long, text string")
    assert [len(r.entropy) for r in M.scan(docs).collect()] == [1]
    assert [len(r.entropy) for r in M.scan(docs, allowed=("^ZXCV",)).collect()] == [0]
    assert [len(r.entropy) for r in M.scan(docs, classes=(M.Class("^[A-Z0-9]+$", 4.4),)).collect()] == [0]
