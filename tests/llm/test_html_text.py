import os
import random
import re
import sys
from html import unescape

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from lattica.llm import html_text as ht  # noqa: E402
from lattica.llm.catalog import op8_html_text  # noqa: E402

SF = "/root/testdata/sf0.01"


def plain(html):
    """Main text of the simple pages of the test tables: one article of h1 and p, inline b and br."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    body = re.split(r"<footer|</body|</html", body)[0]
    blocks = re.split(r"</?(?:h1|p)>", body)
    blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op8_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == plain(pages[r.page_id].html), r.page_id


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("just &lt;text&gt; &amp;  more", "just <text> & more"),
        ("<p>a<p>b<b>c</b>\n d", "a\nbc d"),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "x\ny\nz\nw"),
        ("<body><nav>n</nav><article><h1>T&eacute;</h1><p>one<br>two</p></article><div class=comments>c</div>", "Té\none two"),
        ("<article><p>x</p><aside>s</aside><form>f</form><script>var a='<p>no</p>'</script><p>y</article>", "x\ny"),
        ("<article><div class='AdSlot ad'>buy</div><div role=navigation>n</div><div hidden>h</div>ok</article>", "ok"),
        ("<article>a <!-- c <p>no</p> --> b<article class='comment'>bad</article></article>", "a b"),
        ("<main><div>in</div></main><div>out</div>", "in"),
        ("<article class='post comments-open'><p>kept</p></article>", "kept"),
        ("<div class='has-sidebar content'>kept</div><div id=sidebar>no</div>", "kept"),
        ("<p title='a>b'>q</p></div></p><p a=\"unclosed>r", "q\nr"),
        ("<article><header><p>by x</p><h1>Title</h1></header><p>Solve <math><mi>x</mi></math> <button>now</button></p></article>", "Title\nSolve x now"),
        ("<body><header><h1>Site</h1></header><p>text</p></body>", "text"),
        ("<article><section class=legal><p>l</p></section><p class=side>s</p><p class='social history'>h</p></article>", "l\ns\nh"),
        ("<article><svg><title>no</title><text>label</text></svg><div class=site-header>no</div><div class=header>yes</div></article>", "label\nyes"),
        ("<article><div id=cookie-banner>no</div><div class=comment-list>no</div><p class=notice>yes</p></article>", "yes"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>1 < 2 and a<b>c</p>", "1 < 2 and ac"),
        ("<style>p{}", ""),
        ("<title>t</title><p>x", "x"),
        ("<p>&#233;&nbsp;&unknown; &#x1F600;</p>", "é &unknown; 😀"),
        ("<div>" * 20_000 + "deep", "deep"),
    ],
)
def test_pages(html, text):
    assert ht.extract(html) == text


def test_subtree_hash_sees_tags_marks_and_text():
    h = lambda s: ht.subtree_hashes(r := ht.parse(s))[id(r)]
    assert h("<div><p>a  b</p></div>") == h("<div><p> a b </p></div>")
    assert len({h(s) for s in ("<div>a</div>", "<p>a</p>", "<div class=x>a</div>", "<div>b</div>", "<div><b>a</b></div>")}) == 5


def test_template_is_removed_and_copies_stay(spark):
    frame = "<div><span>Best site ever</span></div>"
    rows = [(k, "http://a.example/%d" % k, f"<body>{frame}<div><p>Story {k} tells of {k * k}</p><p>Same last words</p></div></body>") for k in range(8)]
    rows += [(100 + k, "https://u@B.example:80/x", f"<body>{frame}<div><p>One text, many copies</p></div></body>") for k in range(20)]
    rows += [(200, "http://c.example/", f"<body>{frame}<p>single</p></body>"), (201, None, None), (202, None, ""), (None, "x", "<p>q")]
    rows += [(300 + k, "http://d.example/", f"<article><h1>{k}</h1><div>Read more of us</div><p>We end</p></article>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as row", "'z' as text")
    got = {r.page_id: r.text for r in ht.extract_pages(pages).collect()}
    assert len(got) == len(rows)
    for k in range(8):
        # a paragraph is no container, so the shared last line stays
        assert got[k] == f"Story {k} tells of {k * k}\nSame last words"
    for k in range(20):
        assert got[100 + k] == "Best site ever\nOne text, many copies"
    assert got[200] == "Best site ever\nsingle" and got[201] == got[202] == "" and got[None] == "q"
    for k in range(6):
        assert got[300 + k] == f"{k}\nWe end"
    assert ht.extract_pages(pages.limit(0)).count() == 0
    assert ht.extract_pages(pages.unionAll(pages)).count() == 2 * len(rows)


def test_what_some_articles_of_a_host_share_stays(spark):
    shared = "<section><p>A passage that five edited copies share</p></section><ul><li>one</li></ul>"
    box = "<div>Read more of us</div>"
    rows = [(k, "http://a.example/", f"<article><h1>{k}</h1>{shared if k < 5 else ''}{box}</article>") for k in range(20)]
    rows += [(100 + k, "http://b.example/", f"<body><p>{k}</p>{shared if k < 5 else ''}{box}</body>") for k in range(20)]
    rows += [(200 + k, "http://a.example/", f"<article><h1>{k}</h1>{box}</article>") for k in range(20)]  # copies count once
    got = {r.page_id: r.text for r in ht.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(20):
        want = f"{k}\nA passage that five edited copies share\none" if k < 5 else f"{k}"
        assert got[k] == got[100 + k] == want


def sites():
    """Pages of hosts whose menus, adverts and footers are plain elements without telling names, and the article's text."""
    rng, pages = random.Random(7), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    for host in range(12):
        n = [3, 4, 6, 25, 60][host % 5]
        menu = "<div class=x1><ul>" + "".join(f"<li><a href=/{k}>{line(2)}</a></li>" for k in range(6)) + "</ul></div>"
        foot = f"<div><span>{line(9)}</span><div>{line(4)}</div></div>"
        box = f"<section><p>{line(30)}</p><p>{line(30)}</p></section>"
        for k in range(n):
            text = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))]
            own = "<ul><li>" + line(3) + "</li></ul>"
            body = "".join(f"<p>{t}</p>" for t in text[:-1]) + own + f"<p>{text[-1]}</p>"
            wrapped = [f"<div>{body}</div>", f"<article>{body}{box}</article>", f"<main>{box}{body}</main>"][host % 3]
            html = f"<html><body>{menu}{box if host % 3 == 0 else ''}{wrapped}{foot}</body></html>"
            want = "\n".join([*text[:-1], re.search("<li>(.*)</li>", own)[1], text[-1]])
            pages.append((len(pages), f"https://h{host}.example/{k}", html, want))
    return pages


def test_template_without_telling_names_is_found_by_counting(spark):
    pages = sites()
    table = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract_pages(table).collect()}
    assert got == {k: want for k, _, _, want in pages}
    without = {r.page_id: r.text for r in ht.extract_pages(table, least=10**6).collect()}
    assert all(without[k] != want for k, _, _, want in pages)
