import random
import sys
import time
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from tablemill.llm import html_extract as he

NONE = frozenset()


@pytest.mark.parametrize(
    "broken",
    [
        "<a " + '"a"' * 100_000, "<a " + "x=\"a\"'" * 50_000, "<div>" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<b><div>" * 30_000 + "</b>" * 30_000 + "</p>" * 30_000,
        "<textarea>" * 50_000, "<script>x" * 50_000, "<textarea></textarea " * 30_000, "<!-- " * 100_000, "<![CDATA[" * 50_000, "<a b=\"><a b='>" * 50_000, "<" * 200_000,
        '<a b="' * 100_000 + ">", "<a " + "x" * 300_000 + ">", "<p>" + "&" * 200_000, "<ul>" + "<li>" * 50_000, "<a b=\"\" c=\"><a b=\" d=\"" * 30_000 + ">", "<tr><td>" * 50_000,
        '<p class="' + "ad-" * 100_000 + '">x', '<p class="' + "advert_" * 100_000 + '!">x', "</ " * 100_000, "<a/" * 100_000, "<a =" * 100_000,
    ],
    ids=range(23),
)
def test_broken_pages_end_in_time(broken):
    start = time.process_time()
    text = he.main_text("<p>Before.</p>" + broken, NONE)
    assert time.process_time() - start < 2 and text.startswith("Before.")


def test_text_outside_of_elements_and_markup():
    cases = {
        "hello": "hello", "a < b & c": "a < b & c", "one<p>two</p>three": "one\ntwo\nthree", "x &lt;b&gt; &#x41;&bogus;": "x <b> A&bogus;", "&am<b></b>p;": "&amp;",
        "<p>1 <math><mi>x</mi></math> 2</p>": "1 x 2", "<article><p>a</p><noscript>b</noscript></article><noscript>please</noscript>": "a\nb",
        "<p>cut <a href='x": "cut", "<p title='a > b'>c</p>": "c", "<p title=\"a>c</p>": "c", "<!-- a --><p>b</p><!-->c": "b\nc", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
        "<dl><dt>a<dd>b<dt>c</dl>": "a\nb\nc", "<p>a<br>b": "a\nb", "<svg><text>no</text></svg><p>b": "b", "<p> a  b\n</p>": "a b", "</é><p>é</p>": "é",
    }
    for page, want in cases.items():
        assert he.main_text(page, NONE) == want, page


def test_menus_and_containers():
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(4))
    text = "<p>A paragraph with <a href='/x'>a link</a> in it.</p>"
    assert he.main_text(f"<ul>{links}</ul>{text}", NONE) == "A paragraph with a link in it."
    assert he.main_text(f"<article><ul>{links}</ul>{text}</article><p>Other</p>", NONE) == "Link 0\nLink 1\nLink 2\nLink 3\nA paragraph with a link in it."
    assert he.main_text(f"<p>Top</p><div class='post-content'>{text}<p><a href='/y'>See this</a></p></div>", NONE) == "A paragraph with a link in it.\nSee this"
    assert he.main_text("<article class='comment-body'><p>x</p></article><div class='sidebar-content'>s</div>", NONE) == "x"


def plain_templates(pages):
    """Valid classes by comparing whole occurrence vectors; pages: (host, html)."""
    out, hosts = {}, {}
    for host, page in pages:
        found = [b for b in he.blocks(page) if not b[2]]
        content = tuple(b[1] for b in ([b for b in found if b[3] == 2] or found))
        hosts.setdefault(host, {}).setdefault(content, found)
    for host, contents in hosts.items():
        pages_of = list(contents.values())
        counts = [Counter(x for b in found for x in ((b[0], None), (b[0], b[1]))) for found in pages_of]
        vector = {x: tuple(c[x] for c in counts) for c in counts for x in c}
        classes = {}
        for x, v in vector.items():
            classes.setdefault(v, set()).add(x)
        valid = set()
        for v, members in classes.items():
            n = sum(map(bool, v))
            if len(pages_of) >= he.PAGES and n >= he.PAGES:
                for path, text in members:
                    if text is not None and (n >= he.SHARE * len(pages_of) or ((path, None) in members and n >= he.NESTED * len(pages_of))):
                        valid.add(he.token(path, text))
        out[host] = valid
    return out


def test_equivalence_classes_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(10**6))
    fixed = [f"Fixed line number {k}" for k in range(4)]
    rows = []
    for k in range(120):
        host = "abc"[k % 3] if k % 2 else "hot"
        lines = [f"<p class='c{c}'>{fixed[c]}</p>" for c in range(4) if rng.random() < (1.0, 0.95, 0.3, 0.05)[c]]
        lines += [f"<p>{' '.join(word() for _ in range(6))}</p>" for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.3:
            lines.append("<section><h2>Nested head</h2>" + f"<p>{word()}</p></section>")
        rng.shuffle(lines)
        rows.append((k, f"https://{host}.example.com/{k}", "<body>" + "".join(lines) + "</body>"))
    rows += [(1000 + k, "https://hot.example.com/x", rows[0][2]) for k in range(200)]
    want = plain_templates([(u.split("/")[2], h) for _, u, h in rows])
    assert len(want["hot.example.com"]) >= 2
    df = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
    got = {r.page_id: r for r in df.collect()}
    for i, url, page in rows:
        assert got[i].text == he.main_text(page, frozenset(want[url.split("/")[2]])) and got[i].n_chars == len(got[i].text)


def test_copies_of_an_article_are_no_template(spark):
    same = "<article><h1>Head</h1><p>Body of the one article.</p></article>"
    rows = [(k, f"https://h.example.com/{k}", f"<nav>n</nav><div class='ad'>{k}</div>{same if k < 38 else same.replace('one', str(k))}<footer>f</footer>") for k in range(40)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "Head\nBody of the one article." for k in range(38))


def test_pages_of_the_table(spark):
    """The table's pages mark their article; its text is what is between the tags."""
    import html
    import re

    for r in he.op5_html_extraction(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)
        if inner:
            plain = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner.group(1), flags=re.S)
            plain = re.sub(r"</?(?:b|i|em|strong|a|span|u|code|small|sup|sub)\b[^>]*>", "", plain)
            lines = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", plain)]
            assert [x for x in r.text.split("\n") if x] == [x for x in lines if x], r.page_id


def test_rows(spark):
    rows = [(1, None, None, 1), (1, "no url", "", 2), (None, "https://x.example.com/", "<p>a</p>", 3), (None, "https://x.example.com/", "<p>a</p>", 3)]
    df = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, tokens int").withColumnRenamed("tokens", "host"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, None, "", 0), (1, "no url", "", 0), *[(None, "https://x.example.com/", "a", 1)] * 2], key=str)
