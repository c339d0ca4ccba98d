import random
import re

from ledgerloom.llm import url_filter as M


def glob(pattern, text):
    return re.fullmatch("".join("[^\0]*" if c == "*" else "[^\0]" if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def test_automaton_equals_globs():
    rng = random.Random(1)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(40):
        globs = [pick("ab*?\0.", 9) for _ in range(30)] + ["*" * 5 + "a", "", "*", "a" * 130 + "*"]
        texts = [pick("abc.\0", 12) for _ in range(60)] + ["", "a" * 140, "a" * 129]
        found = M.Automaton(globs).matches(texts)
        for i, t in enumerate(texts):
            assert found[i].tolist() == [glob(g, t) for g in globs], t


def plain(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end])
        path = re.split("[?#]", rest[end:])[0]
    fits = [r for r in M.HOST_RULES if (h := r.text.partition("/")) and (host == h[0] or host.endswith("." + h[0])) and path.startswith("/" + h[2])]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "block" if any(glob(g, f".{host}\0{path}") for g in M.BLOCK_GLOBS) else "allow"


def test_rows(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/x?y#z", "http://example.net", "http://a.b.example.net/de", "https://notexample.com/de/", "https://x.example.com/de/a", "http://é.org/fr/?q", "http://org/fr/", "ftp://ads.shop.example.org/a",
            "http://h.org/a/login", "x://y://z/w", "http://h.org\n/fr/a", "http://net/", "http://net", "http://h?p/", "http://" + "a." * 3000 + "net/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], ""), (None, urls[4], "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = sorted(map(tuple, M.filter_urls(frame).collect()), key=str)
    assert got == sorted([(i, *plain(u)) for i, u, _ in rows], key=str)
    assert M.filter_urls(frame.limit(0)).count() == 0
