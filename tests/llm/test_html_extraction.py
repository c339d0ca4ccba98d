import random
from collections import Counter

import numpy as np

from ledgerloom.llm import html_extraction as M

SCHEMA = "page_id long, url string, html string, text string, host string"


def text(page):
    return M.read_page(page)[0]


def test_article_is_kept_whole():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><div id="cookie-notice">cookies</div>
    <main><header><h1>Head &amp; tail&nbsp;x</h1></header><p><b>Bold.<br><p>Second
    line &lt;b&gt; &#233;&#x41;</p><ul><li>one<li>two</ul><aside>side</aside><form><input>send</form><table><tr><td>c1<td>c2</table>
    <div class="comments"><p>reader</p></div><p hidden>no</p><p>a <i>b</i><a href="x>y">c</a></p></main>
    <section class="comments">more</section><footer>foot</footer></body>"""
    assert text(page) == "Head & tail x\nBold.\nSecond line <b> éA\none\ntwo\nc1\nc2\na bc"


def test_broken_markup():
    assert text("<article><p>a<p>b</article>") == "a\nb"
    assert text("<article><div>a<script>x</article>") == "a"
    assert text("<article>1 < 2 <p>x <!-- never closed") == "1 < 2\nx"
    assert text("<article><article class='comment'>no</article>yes</article>") == "yes"
    assert text("<ARTICLE>Up</ARTICLE>") == "Up"
    assert text("<nav>only a menu</nav>") == "" and text("") == ""
    assert text("<div class='page-header'>x</div><article><div class='post-header'>title</div>y</article>") == "title\ny"
    assert text("no markup") is None  # left to the host's pages


def test_suffix_array_and_counts():
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 3, rng.integers(6, 40)).astype(np.uint64) for _ in range(30)]
    runs, n = M.shared_runs(pages)
    want = Counter(h for p in pages for h in set(M.grams(p, M.RUN).astype(np.int64).tolist()))
    assert dict(zip(runs.tolist(), n.tolist(), strict=True)) == want
    tokens = rng.integers(0, 4, 300).astype(np.uint64)
    keys = [tuple(tokens[i : i + M.RUN]) for i in M.suffix_array(tokens)]
    assert keys == sorted(keys)


def test_undecided_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "ARRAY_TOKENS", 100)
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    top, bottom = line(8), line(12)
    own = [line(40) for _ in range(30)]
    rows = [(i, f"https://h.example.com/{i}", f"<div>{top}</div><div>{o}</div><div>{bottom}</div>") for i, o in enumerate(own)]
    rows += [(100 + i, f"https://other{i}.example.com/", f"<div>{top}</div><p>{o}") for i, o in enumerate(own[:5])]  # no host of theirs repeats it
    rows += [(200, "https://h.example.com/copy", rows[0][2]), (201, None, None), (202, "x", ""), (0, rows[0][1], rows[0][2]), (None, "https://h.example.com/a", f"<article>{top} x</article><p>{own[1]}")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    got = {}
    for r in M.main_text(frame).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] == [own[i]] for i in range(1, 30)) and got[0] == [own[0]] * 2 and got[200] == [own[0]]
    assert all(got[100 + i] == [f"{top}\n{own[i]}"] for i in range(5))
    assert got[201] == got[202] == [""] and got[None] == [f"{top} x"]
    assert M.main_text(frame.limit(0)).count() == 0


def test_an_article_in_a_wrapper_like_chrome_is_kept():
    for wrapper in ("<form id='aspnetForm'>", "<div class='layout no-sidebar'>", "<div class='post with-comments'>", "<div class='search-results'>", "<section class='has-footer'>"):
        for tag in ("article", "main"):
            assert text(f"<body>{wrapper}<nav>menu</nav><{tag}><p>a</p><form>f</form><aside>s</aside></{tag}><footer>foot</footer>") == "a", (wrapper, tag)
    assert text("<div class='comments'><article>reader</article></div><article>yes</article>") == "yes"
    assert text("<div hidden><article>no</article></div><article>yes</article>") == "yes"
    assert text("<main>a<aside><article>teaser</article></aside></main>") == "a"


def test_titles_and_quotes():
    assert text("<h1>Title</h1><article><p>a</p></article>") == "Title\na"
    assert text("<h1>Site</h1><article><h1>Title</h1><p>a</p></article>") == "Title\na"
    assert text("<article><p title=it's>a</p><p title='x>y' class=\"b'c\">b</p></article>") == "a\nb"
    assert text("<article>a&nbsp;&nbsp;b \xa0 c</article>") == "a b c"
    assert text("<article>a <b unfinished") == "a"


def test_hostile_pages_are_read_in_linear_time():
    import time

    for part in ("<a ", "<div>", "<b><p>", "<!--", "<a x=\"", "<a x='\"", "<script>", "</p>", "<p title=", "&amp", "<![CDATA[", "<li><b>", "< "):
        began = time.process_time()
        text("<article>x</article>" + part * (1_000_000 // len(part)))
        assert time.process_time() - began < 30, part


def test_pages_of_hosts_without_undecided_blocks_are_not_moved(spark, monkeypatch):
    split, moved = M.split_by_key, []

    def seen(rows, special):
        same, perhaps = split(rows, special)
        moved.append(perhaps.count())
        return same, perhaps

    monkeypatch.setattr(M, "split_by_key", seen)
    rows = [(i, f"https://closed.org/{i}", f"<article>text {i}</article>") for i in range(50)] + [(100 + i, f"https://open.org/{i}", f"<div>block number {i} of a page</div>") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in M.main_text(frame).collect()}
    assert got == {i: f"text {i}" for i in range(50)} | {100 + i: f"block number {i} of a page" for i in range(4)}
    assert moved == [4]
