"""HTML extraction and embedding near-dedup."""

import re
from html.parser import HTMLParser

import numpy as np
import pytest

from litsieve.llm import html_extract as H
from litsieve.llm import projection_dedup as P

PAGES = [
    ("<p>a<p>b", "", [("a", False), ("b", False)]),
    ("<article><h1>T &amp; x</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "", [("T & x", True), ("one two three", True), ("four", True)]),
    ("<nav>menu<article><p>a</p></article>", "", [("a", True)]),
    ("<article><p>a</p><div class='ad'>buy</div><section id=comments><article>c</article></section><p>b</article>", "", [("a", True), ("b", True)]),
    ("<script>var t='</p><article>x</article>'</script><style>p{}</style><p>a<!-- c --></p><!-- open", "", [("a", False)]),
    ("a < b &lt;c&gt; <b>d</b>e", "", [("a < b <c> de", False)]),
    ("<form><p>f</p></form><aside>s</aside><header>h</header><main><p>m</p></main>", "", [("m", True)]),
    ("<article>a <span class='share'>tweet</span> b<p hidden>h</p></article>", "", [("a b", True)]),
    ("", "", []),
    ("<article", "", []),
    ('<p title="a>b">x</p>', "", [("x", False)]),
]


@pytest.mark.parametrize("case", range(len(PAGES)))
def test_blocks(case):
    page, _, want = PAGES[case]
    assert H.blocks(page) == want


def test_suffix_array():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 200):
        t = r.integers(0, 3, n)
        assert H.suffix_array(t).tolist() == sorted(range(n), key=lambda k: t[k:].tolist())


def test_runs_against_brute_force():
    r = np.random.default_rng(2)
    streams = [r.integers(0, 2, n) for n in (0, 3, 12, 30, 12)]
    of, where, pages = H.runs(streams, 4)
    at, want = 0, {}
    for k, s in enumerate(streams):
        for i in range(len(s) - 3):
            want.setdefault(tuple(s[i : i + 4]), set()).add(k)
        at += len(s) + 1
    tokens = np.concatenate([np.append(s, -1) for s in streams])
    got = {tuple(tokens[w : w + 4]): n for w, n in zip(where, pages, strict=True)}
    assert got == {k: len(v) for k, v in want.items()}
    assert len(of) == len(tokens)


def test_open_pages(spark):
    menu = "<div>" + " ".join(f"item{k}" for k in range(12)) + "</div>"
    rows = [(k, f"https://h.example/{k}", f"{menu}<div>own text of page {k} with words {' '.join(f'u{k}x{j}' for j in range(12))}</div>") for k in range(6)]
    rows += [(10, "https://other.example/1", menu + "<div>alone</div>"), (11, None, None), (12, "::bad", ""), (13, "https://h.example/a", "<article>kept item0</article>")]
    rows += [(14, None, f"<div>{menu}</div>"), (15, "no host", f"<div>{menu}</div>")]  # share no host with anything
    for shard in (20, 500_000):
        df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").repartition(3)
        got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(df, tokens_per_shard=shard).collect()), key=repr)
        assert len(got) == 13
        texts = {i: t for i, t, _ in got}
        assert all(texts[k].startswith(f"own text of page {k}") and "item" not in texts[k] for k in range(6))
        assert texts[10].endswith("\nalone") and texts[11] == texts[12] == "" and texts[13] == "kept item0"
        assert texts[14] == texts[15] == " ".join(f"item{k}" for k in range(12))
        assert all(n == len(t) for _, t, n in got)
    assert H.extract(df.limit(0)).count() == 0


def covered_by_brute_force(bodies, n, pages):
    """Which tokens of each body lie in a run of n tokens that as many distinct bodies hold."""
    flat = [tuple(w for b in body for w in b.split()) for body in bodies]
    held = {}
    for k, words in enumerate(flat):
        for i in range(len(words) - n + 1):
            held.setdefault(words[i : i + n], set()).add(k)
    out = []
    for words in flat:
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if len(held[words[i : i + n]]) >= pages:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


@pytest.mark.parametrize("shard", [3000, 500_000])
def test_real_pages_without_marks(spark, sf, shard):
    """The supplied pages with every mark taken off, so that the arrays decide all of them, against brute force."""
    rows = []
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page = p.html
        for tag in ("article", "nav", "footer"):
            page = page.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        rows.append((p.page_id, "https://one.example/" if p.page_id % 3 else "https://two.example/", page.replace('<div class="ad">', "<div>")))
    rows += [(10**6 + i, u, h) for i, u, h in rows[:5]]  # equal bodies
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), tokens_per_shard=shard).collect()}
    changed = 0
    for host in {u for _, u, _ in rows}:
        bodies = {i: tuple(t for t, _ in H.blocks(h)) for i, u, h in rows if u == host}
        distinct = sorted(set(bodies.values()))
        gone = dict(zip(distinct, covered_by_brute_force(distinct, H.MIN_RUN, H.MIN_PAGES), strict=True))
        for i, body in bodies.items():
            at, kept = 0, []
            for block in body:
                words = block.split()
                marks = "".join("x" if x else "." for x in gone[body][at : at + len(words)])
                marks = re.sub(r"^x+$", lambda m: "-" * len(m[0]), re.sub(f"x{{{H.MIN_RUN},}}", lambda m: "-" * len(m[0]), marks))
                kept.append(" ".join(w for w, x in zip(words, marks, strict=True) if x != "-"))
                at += len(words)
            assert got[i] == "\n".join(k for k in kept if k)
            changed += any(gone[body])
    assert changed > 0 and len(got) == len(rows)


class ArticleText(HTMLParser):
    """The article's blocks by the standard library's parser: another way to the same text where the marks decide."""

    BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "ul", "ol", "div", "table", "tr", "td", "th", "blockquote", "pre", "section", "figure"}

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style") or (tag == "div" and ("class", "ad") in attrs)
        if tag in self.BLOCKS or tag == "article":
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip = max(0, self.skip - (tag in ("script", "style", "div")))
        if tag in self.BLOCKS or tag == "article":
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.blocks[-1] += data


def test_query_on_real_pages(spark, sf):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op5_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = ArticleText()
        parser.feed(pages[r.page_id].html)
        parser.close()
        assert r.text == "\n".join(t for b in parser.blocks if (t := " ".join(b.split()))) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_query_on_real_vectors(spark):
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.op10_projection_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 0.93)


def test_unique_runs_of_a_block_stay(spark):
    same = " ".join(f"w{k}" for k in range(20))
    rows = [(k, "https://h.example/", f"<div>{same} " + " ".join(f"own{k}x{j}" for j in range(8)) + "</div>") for k in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: " ".join(f"own{k}x{j}" for j in range(8)) for k in range(3)}


def test_pages_awkward(spark):
    rows = [(None, None, None), (1, "", "<article>" + "long words here " * 200_000 + "</article>"), (1, "", "<article>same id</article>"), (2, "https://h.example/", None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r.page_id, r.n_chars) for r in H.extract(df).collect()), key=repr)
    assert got == sorted([(None, 0), (1, 16 * 200_000 - 1), (1, 7), (2, 0)], key=repr)


def brute(rows, threshold):
    ok = {k: np.array(v, float) for k, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0}
    label = {k: l for k, l, _ in rows}
    links = {k: set() for k, _, _ in rows}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and label[a] == label[b] and len(x) == len(y) and (x == y).all() or (a != b and label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold):
                links[a].add(b)
    component = {k: k for k in links}
    changed = True
    while changed:
        changed = False
        for a in links:
            least = min([component[a], *(component[b] for b in links[a])])
            if least < component[a]:
                component[a], changed = least, True
    return {k: (len(links[k]), component[k], component[k] == k) for k in links}


def vectors(seed=3):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(40):
        base = r.normal(size=16)
        for _ in range(int(r.choice([1, 1, 2, 40]))):
            v = base + r.normal(scale=0.12, size=16) * r.choice([0, 1, 1.5])
            rows.append((k, int(g % 3), [float(np.float32(x)) for x in v]))
            k += 1
    rows += [(9001, 1, None), (9002, 1, []), (9003, 1, [0.0] * 16), (9004, 1, [None] + [1.0] * 15), (9005, 1, [float("nan")] + [1.0] * 15), (9006, None, rows[0][2]), (9007, 0, [1.0, 2.0]), (9008, 0, [1.0, 2.0]), (9009, 1, [float("inf")] * 16)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(a, c, b, 0) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
    for window in (64, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.near_vectors(df, window=window).collect()}
        want = brute(rows, 0.93)
        assert set(got) == set(want)
        found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
        assert all(got[k][0] <= want[k][0] for k in got) and found >= 0.98 * there
    assert P.near_vectors(df.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    """Two unrelated pairs and a copy share the id 1; each row keeps its own vector's links."""
    x, y = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, x, 0), (1, y, 0), (1, x, 0), (2, [1.0, 0.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.1, 0.0], 0), (None, [0.0, 1.0, 0.2, 0.0], 0), (None, [0.0, 0.0, 1.0, 0.0], 0), (9, x, None)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in P.near_vectors(df).collect()), key=repr)
        want = [(1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (9, 0, 9, True)]
        assert got == sorted(want, key=repr)


def test_passes_grow_with_the_label():
    assert P.passes_needed(10, 0.93, 64) == 2 < P.passes_needed(5000, 0.93, 64) < P.passes_needed(10**6, 0.93, 64) < P.passes_needed(10**12, 0.93, 64)


def planted(spread, n=4000, pairs=1000, dims=64, seed=5):
    """Vectors around one direction (spread 1: around none), with planted pairs a little above the threshold."""
    r = np.random.default_rng(seed)
    x = (1 - spread) * r.normal(size=dims) + spread * r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=(pairs, dims))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    cosine = r.uniform(0.931, 0.945, (pairs, 1))
    x[n - pairs :] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return x.astype(np.float32)


@pytest.mark.parametrize(("spread", "window"), [(1.0, 16), (0.55, 8)])
def test_recall_of_passes(spark, spread, window):
    """Passes (not all pairs) find at least 0.99 of the links near the threshold, whatever the number of partitions."""
    x = planted(spread)
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (units @ units.T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 2000
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").cache()
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append([r.n_links for r in P.near_vectors(df, window=window).orderBy("vec_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert (np.array(found[0]) <= want).all() and sum(found[0]) >= 0.99 * want.sum()


@pytest.mark.parametrize("n", [150, 5000])
def test_labels_take_passes_at_the_usual_window(spark, monkeypatch, n):
    """A label of the supplied tables' size and a large one: their links come from passes, not from all pairs."""
    x = planted(1.0, n=n, pairs=n // 5)
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (units @ units.T >= 0.93).sum(axis=1) - 1
    seen, pass_rows, planned = [], P._pass_rows, P._planned
    monkeypatch.setattr(P, "_pass_rows", lambda *a: seen.append("passes") or pass_rows(*a))

    def plan(*a):
        out = planned(*a)
        seen.append(out.where("exact").count())
        return out

    monkeypatch.setattr(P, "_planned", plan)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = [r.n_links for r in P.near_vectors(df).orderBy("vec_id").collect()]
    assert seen[0] == "passes" and sum(k for k in seen if k != "passes") == 0  # no label was compared whole
    assert (np.array(got) <= want).all() and sum(got) >= 0.99 * want.sum() > 0


def off_centre(n=3000, pairs=300, dims=64, seed=5):
    """One label whose vectors lie around one direction (mean cosine about 0.84), with planted pairs at 0.935 or more."""
    r = np.random.default_rng(seed)
    x = r.normal(size=dims) / np.sqrt(dims) + 0.44 * r.normal(size=(n, dims)) / np.sqrt(dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=(pairs, dims))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    x[n - pairs :] = 0.935 * x[:pairs] + np.sqrt(1 - 0.935**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return x.astype(np.float32)


def test_every_link_of_a_dense_label(spark):
    x = off_centre()
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (units @ units.T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 600
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in P.near_vectors(df).collect()}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum()


def test_counts_within_components_are_exact(spark):
    rows = vectors(8)
    df = spark.createDataFrame([(a, c, b) for a, b, c in rows], "vec_id long, embedding array<float>, label int")
    for group_bytes in (P.GROUP_BYTES, 2_000):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.near_vectors(df, group_bytes=group_bytes).collect()} == brute(rows, 0.93)


IN_ARTICLE = [
    ('<section id="related-work"><p>a</p></section><p>b</p>', [("a", True), ("b", True)]),
    ('<h2 id="market-share">Share</h2><h2 class="search">S</h2><p id="ad-hoc" data-id="ad">b</p>', [("Share", True), ("S", True), ("b", True)]),
    ('<div data-id="ad">a</div>', [("a", True)]),
    ("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p>", [("x y=2 z", True)]),
    ("<p>a <button>b</button> <object>c</object> <svg><text>d</text></svg></p>", [("a b c", True), ("d", True)]),
    ('<p>a <span class="token comment">b</span></p>', [("a b", True)]),
    ('<div class="search-results"><p>a</p></div><p>b</p>', [("a", None), ("b", True)]),
    ('<div class="share-buttons">s</div><div class="ad">s</div><div role="navigation">n</div><p>b</p>', [("b", True)]),
]


@pytest.mark.parametrize("case", range(len(IN_ARTICLE)))
def test_blocks_of_an_article(case):
    inside, want = IN_ARTICLE[case]
    assert H.blocks(f"<body><article>{inside}</article><svg><text>out</text></svg><button>out</button></body>") == want


@pytest.mark.parametrize("page", ['<h2 id="ad-hoc-methods">a b</h2>', '<h2 id="search-results">a b</h2>', '<div class="related-work">a b</div>', '<p class="share-price">a b</p>', '<div id="ad-hoc">a b</div>'])
def test_parts_of_names_are_no_marks(spark, page):
    for body in (f"<article><p>x</p>{page}</article>", f"<p>x</p>{page}"):
        df = spark.createDataFrame([(1, "https://h.example/", body)], "page_id long, url string, html string")
        assert H.extract(df).first().text == "x\na b"


def test_doubtful_blocks_go_only_if_repeated(spark):
    def page(k, doubtful):
        return f"<article><p>text {k}</p><div class=search-results>{doubtful}</div><p>end</p></article><p>outside</p>"

    same = "this notice of ten words stands on every such page"
    own = [" ".join(f"own{k}x{j}" for j in range(10)) for k in range(3)]
    rows = [(k, "https://h.example/", page(k, same if k < 3 else own[k - 3])) for k in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text {k}\nend" if k < 3 else f"text {k}\n{own[k - 3]}\nend" for k in range(6)}
