"""What marks on pages mean: attributes by their own names, comments and notices, roles, deep markup; pages that marks leave open."""

import time

import pytest
from litsieve.llm import html_extract as H


def article(inner):
    return "\n".join(t for t, main in H.blocks(f"<nav>m</nav><article><p>before</p>{inner}<p>after</p></article><footer>f</footer>") if main is not False)


KEPT = [
    '<p title="a hidden treasure">x</p>',
    '<p data-note="display: none in print">x</p>',
    '<p data-class="ad">x</p>',
    "<p data-x='class=\"comment\"'>x</p>",
    '<p hidden=until-found>x</p>',
    '<p aria-hidden="false">x</p>',
    '<p style="color: red; content: none">x</p>',
    '<p aria-label="aria-hidden=true">x</p>',
    '<h2 id="comment">x</h2>',
    '<h2 class="notice">x</h2>',
    '<p class="notice">x</p>',
    '<p>a <em class="comment">b</em> c</p>',
    '<section id="related-work"><p>x</p></section>',
    '<p class="commentary">x</p>',
    "<p CLASS='x' class='ad'>x</p>",
]
DROPPED = [
    "<p hidden>x</p>",
    "<p HIDDEN=''>x</p>",
    '<p aria-hidden="true">x</p>',
    "<div aria-hidden=TRUE>x</div>",
    '<p style="color:red;display:none">x</p>',
    "<p style='DISPLAY : NONE !important'>x</p>",
    '<p style="display&#58;none">x</p>',
    '<div class="comment">x</div>',
    '<div class="entry comment">x</div>',
    '<ol class="commentlist"><li class="comment-body">x</li></ol>',
    '<ol class="comments"><li>x</li></ol>',
    '<ul><li class="comment_body">x</li></ul>',
    '<section id="comments"><article class="comment">x</article></section>',
    '<div class="notice">x</div>',
    '<div class="cookie">x</div>',
    "<div class=ad>x</div>",
    '<div role="navigation">x</div>',
    "<div role='search'>x</div>",
]


@pytest.mark.parametrize("inner", KEPT)
def test_kept(inner):
    text = article(inner)
    assert text.startswith("before\n") and text.endswith("\nafter") and text.count("\n") == 2, text


@pytest.mark.parametrize("inner", DROPPED)
def test_dropped(inner):
    assert article(inner) == "before\nafter"


@pytest.mark.parametrize("role", ["role='main'", 'role="main"', "role=main", "ROLE = 'Main'", 'role="presentation main"'])
def test_main_by_role(role):
    assert H.blocks(f"<div>x</div><div {role}><p>y</p></div><div>z</div>") == [("x", False), ("y", True), ("z", False)]
    assert H.blocks("<div data-role='main'>x</div><div title='role=\"main\"'>y</div>") == [("x", False), ("y", False)]


@pytest.mark.parametrize("unit", ["<div>a", "<span class=x>a", "<nav>", "</b>", "<div></span>", "<b></i>", "<nav><article>", "<li>a", "<p a='b", "<!--", "<a <", '<div class="', "<b class=ad>", "</div>"])
def test_markup_without_end_takes_linear_time(unit):
    seconds = []
    for n in (20_000, 80_000):
        page = unit * n
        began = time.process_time()
        H.blocks(page)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * max(seconds[0], 0.05), seconds


def test_query_where_the_array_decides_some_blocks(spark, tmp_path):
    """Pages with an article whose names are in doubt, pages without any, and marked ones, through the query."""
    same = " ".join(f"word{k}" for k in range(12))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(12))
    rows = []
    for k in range(6):
        rows.append((k, "https://h.example/a", f'<article><p>sure {k}</p><div class="search-results">{same}</div><div class="related-work">{own(k)}</div></article>'))
        rows.append((10 + k, "https://h.example/b", f"<div>{same}</div><div>{own(10 + k)}</div><nav>{same}</nav>"))
        rows.append((20 + k, f"https://h{k}.example/", f"<div>{same}</div><div>{own(20 + k)}</div>"))
        rows.append((30 + k, "https://h.example/c", f"<main>{same}</main><div>{own(30 + k)}</div>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in H.op5_html_extract(spark, str(tmp_path)).collect()}
    for k in range(6):
        assert got[k] == f"sure {k}\n{own(k)}" and got[10 + k] == own(10 + k)  # the host repeats the rest
        assert got[20 + k] == f"{same}\n{own(20 + k)}" and got[30 + k] == same  # another host each; marks are never overruled


def test_marked_pages_tell_what_a_host_repeats(spark):
    """The one page of a host without marks: what its marked pages carry outside their articles goes, what is its own stays."""
    same, own = " ".join(f"same{k}" for k in range(12)), " ".join(f"own{k}" for k in range(12))
    rows = [(k, "https://h.example/a", f"<div>{same}</div><article><p>text {k} of its own</p></article>") for k in range(3)]
    rows += [(9, "https://h.example/b", f"<div>{same}</div><div>{own}</div>"), (10, None, f"<div>{same}</div><main>m</main>")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"text {k} of its own" for k in range(3)}, 9: own, 10: "m"}
