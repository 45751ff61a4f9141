"""Tag-path ratios: pages with their marks and without, against texts made another way."""

import html as html_lib
import os
import re
from collections import Counter

import pytest

from linkforge.llm import html

FOLDER = "/root/testdata/sf0.01"
PROSE = "The quick brown fox, they say, jumps over the lazy dog; nobody has seen it. Why would it?"


def without_marks(page):
    """All sections become div, and no element has a class, id or role."""
    return re.sub(r"(</?)(article|nav|footer|aside|main|header|section)\b", r"\1div", re.sub(r' (class|id|role)="[^"]*"', "", page))


def plain(page):
    """The article of a page of the given tables, cut out by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", " " if "br" in b else "", re.sub(r"<br\s*/?>", " ", b)) for b in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(x for x in (" ".join(html_lib.unescape(b).split()) for b in blocks) if x)


@pytest.fixture(scope="module")
def pages(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return [r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()]


def test_given_pages(pages):
    assert all(html.main_text(p) == plain(p) for p in pages)


def test_ratios_decide_without_marks(pages):
    kept = right = wanted = removing = 0
    for p in pages:
        blocks, lines = html.read_blocks(without_marks(p)).blocks, html.main_text(without_marks(p)).split("\n")
        want = html.main_text(p).split("\n")
        right += sum((Counter(lines) & Counter(want)).values())
        kept, wanted, removing = kept + len(lines), wanted + len(want), removing + (len(lines) < len(blocks))
    assert right >= 0.95 * kept and right >= 0.95 * wanted and removing >= 0.9 * len(pages)


def test_lists_tables_and_references_stay():
    """What an article has beside paragraphs is returned, short or linked as it may be; menus and comments aren't."""
    body = f"<h1>T</h1><p>{PROSE}</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><p>{PROSE}</p><ol><li><a href=a>Smith, J. A work.</a><li><a href=b>Jones, K. Another.</a></ol>"
    want = ["T", PROSE, "x", "y", "1", "2", PROSE, "Smith, J. A work.", "Jones, K. Another."]
    around = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div>{}</div><div>Imprint</div>"
    assert html.main_text(around.format(body)).split("\n") == want
    marked = f"<nav>Home</nav><main>{body}<section class=comments><p>{PROSE} {PROSE}</p></section><div class='share-links'>Share</div></main><footer>{PROSE}</footer>"
    assert html.main_text(marked).split("\n") == want
    menu = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    prose = f"<h1>T</h1><p>{PROSE}</p><ol><li>x<li>y</ol><p>{PROSE}</p>"
    assert html.main_text(f"<article>{menu}{prose}</article>").split("\n") == ["T", PROSE, "x", "y", PROSE]


def test_pages_without_an_article():
    assert html.main_text("<nav>a</nav><footer>b</footer>") == "" and html.main_text("<p hidden>a</p>") == ""
    assert html.main_text("just text") == "just text" and html.main_text("<p>one<p>two") == "one\ntwo"
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
