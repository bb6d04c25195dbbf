import json
import random
import time

import pytest

from auditweave.llm import wrappers
from tests.llm.conftest import text


def said(page):
    return " ".join(t for _, t in wrappers.blocks_of(page, None))


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<b>b</b>c<br>d &amp; e&#x41;&nbsp;&eacute;", "abc d & eA é"),
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>H</h1><p>one<p>two <i>x</i><ul><li>l1<li>l2</ul></article><footer>f</footer>", "H one two x l1 l2"),
    ("<article><p>a</p><div class='share-buttons'>Share</div><section id=comments><p>rude</p></section><p>b</p></article><aside>c</aside>", "a b"),
    ("<div class='sidebar'><p>s</p></div><div class=main-text><p>long enough text here</p></div><p><a href=x>only a link</a></p>", "long enough text here"),
    ("<article><script>var a='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><p>yes<noscript>no</noscript></p><form>f<input></form></article>", "yes"),
    ("<header><h1>site</h1></header><main><article><header><h1>title</h1></header><p>body</article></main>", "title body"),
    ("<article><p hidden>no</p><p style='display:none'>no</p><p aria-hidden='true'>no</p><p>a</p> tail<span class=\"ad\">buy</span>rest</article>", "a tail rest"),
    ("<table><tr><td>1<td>2<tr><td>3</table>x < y and a<3 <1", "1 2 3 x < y and a<3 <1"),
    ("<article><p>unclosed <b>bold <p>next</article><footer>f</footer></div></b>", "unclosed bold next"),
    ("<main><article><p>text</p></article><article class='comment'><p>rude</p></article><article class='ad-slot'><p>buy</p></article></main>", "text"),
    ("<article><p>a</p><section class='related-work'><p>b</p></section><p class='notice-of-law'>c</p><p class='comments'>d</p></article>", "a b c"),
    ("<p title=\"a > b\">in</p><p title=\"open>odd</p><![CDATA[raw]]>", "in odd raw"),
])
def test_pages(page, want):
    assert said(page or "") == want


def tree(r, depth):
    return [r.choice("abc"), 0, [tree(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else []]


def size(a, b):
    """Plain recursion of simple tree matching."""
    if a[0] != b[0]:
        return 0

    def forest(x, y):
        if not x or not y:
            return 0
        return max(forest(x[1:], y), forest(x, y[1:]), size(x[0], y[0]) + forest(x[1:], y[1:]))

    return 1 + forest(a[2], b[2])


def test_simple_tree_matching():
    r, kin = random.Random(6), lambda t: (t[0], t[2])
    for _ in range(200):
        a, b = tree(r, 3), tree(r, 3)
        n, pairs = wrappers.match(a, b, kin)
        assert n == size(a, b) == len(pairs) and all(x[0] == y[0] for x, y in pairs)


def page(i, extra=""):
    return f"<html><body><div class='top'><p>{text(i, 4)}</p></div><div class='body'><p>Welcome to our pages</p><h2>{text(50 + i, 5)}</h2><p>{text(100 + i, 20)}</p>{extra}</div><div><p>All prices are final</p></div></body></html>"


def frame(session, rows):
    return session.createDataFrame(rows, "page_id long, url string, html string")


def test_constant_slots_of_a_host_are_template(session):
    rows = [(i, f"http://shop.example.net/{i}", page(i, f"<p>{text(300 + i, 9)}</p>" * (i % 3))) for i in range(20)]
    rows += [(100 + i, f"http://small.example.net/{i}", page(i)) for i in range(3)]  # too few pages to learn from
    rows += [(200 + i, "http://copies.example.net/", page(1)) for i in range(20)]  # copies of one page
    got = {x.page_id: x.text for x in wrappers.main_text(frame(session, rows)).collect()}
    for i in range(20):
        assert got[i] == " ".join([text(i, 4), text(50 + i, 5), text(100 + i, 20), *[text(300 + i, 9)] * (i % 3)])
    assert "Welcome to our pages" in got[100] and got[200] == said(page(1))


def test_blocks_of_one_page_teach_nothing(session):
    """Copies of a page with neighbouring paragraphs that differ; equal items of one page beside paragraphs."""
    copy = f"<article><h1>{text(1, 5)}</h1><p>{text(2, 9)}</p><p>{text(3, 9)}</p></article>"
    items = f"<article><p>{text(4, 9)}</p><p>{text(5, 9)}</p><ul>{'<li>same again</li>' * 12}</ul></article>"
    rows = [(i, "http://copies.example.net/", copy) for i in range(20)] + [(100, "http://items.example.net/", items)]
    got = {x.page_id: x.text for x in wrappers.main_text(frame(session, rows)).collect()}
    assert {got[i] for i in range(20)} == {said(copy)} and got[100] == said(items)


def test_members_of_a_repeated_node_share_a_slot():
    reference = wrappers.tree_of(wrappers.skeleton(wrappers.parse("<ul><li><p>a</p></li><li><p>b</p></li></ul><p>c</p>")[0]))
    assert json.loads(json.dumps(reference)) == reference
    slots = [s for s, _ in wrappers.blocks_of("<ul><li><p>1</p></li><li><p>2</p></li><li><p>3</p></li></ul><p>4</p><section>5</section>", reference)]
    assert slots[0] == slots[1] == slots[2] and slots[3] not in (slots[0], -1) and slots[4] == -1


def test_edges(session):
    rows = [(1, None, None), (None, "http://a.example.net/x", page(1)), (2, "no url", ""), (2, "no url", ""), (3, "HTTP://A.example.net:80/", "<p>x" + "<div>" * 300 + "deep"), (4, "http://b.example.net", "<p>" + text(1, 30000))]
    pages = frame(session, rows).selectExpr("*", "1 AS slot", "'x' AS host", "2 AS blocks", "3 AS tree")
    got = wrappers.main_text(pages).collect()
    assert len(got) == 6 and {x.text for x in got if x.page_id == 2} == {""} and all(x.text is not None for x in got)
    assert next(x.text for x in got if x.page_id == 4) == text(1, 30000) and next(x.text for x in got if x.page_id == 3) == "x deep"
    assert wrappers.main_text(frame(session, [])).count() == 0


def test_deep_and_unclosed_markup(session):
    """In time that grows with the page only, and without deep recursion."""
    deep = "<div>" * 50_000 + "<p>core" + "</p><p>more" + "</div>" * 20
    pages = [(i, "http://x/", h) for i, h in enumerate([deep, deep + "<p>x", "<a " * 300_000 + "end", "<p>x" + "<div " * 200_000, "<" * 300_000, "<p 'a" * 100_000, "<!-- <p>" * 50_000])]
    started = time.time()
    got = {r.page_id: r.text for r in wrappers.main_text(frame(session, pages)).collect()}
    assert time.time() - started < 120
    assert (got[0], got[1]) == ("core more", "core more x") and got[2].endswith("<a end") and got[3].startswith("x<div") and got[4] == "<" * 300_000
