"""Main text of pages: the parser on awkward markup, alignment against brute force, wrappers on sites with templates."""

import html as entities
import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import dom, main_text, queries

SCHEMA = "page_id long, url string, html string, text string, host string, _host string, constant int"


def read(page):
    return "\n".join(x.text for x in dom.content(dom.parse(page)))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b <b>c<br>d</b>\n\te", "a\nb c d e"),
        ("<article><p><b>one<br><p>two</p></article>x", "one\ntwo"),
        ("<p>1 < 2 &amp; 3 &gt 2 &am &copy; &#x41;&#66; &nbsp; z</p>", "1 < 2 & 3 > 2 &am © AB z"),
        ("<p>a<!-- no --><i>b</i><!---->c</p><!-- open", "abc"),
        ('<script>var t="</p><p>no</p>";</script><style>p{}</style><p title="a > b">yes</p><script>open', "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("<nav>no</nav><header>no</header><main><header><h1>T</h1></header><p>x</p><aside>no</aside></main><footer>no</footer>", "T\nx"),
        ('<body class="has-sidebar"><div class="sidebar"><article><p>in</p></article><p>out</p></div>', "in"),
        ('<div id="content"><p>x</p></div><div class="cookie-notice">no</div><div class=adBox>no</div><section id=comments><article>no</article></section>', "x"),
        ('<article><p>x</p><div class="comments"><article><p>no</p></article></div><form>no</form></article>', "x"),
        ("<form><h1>t</h1><div>whole page in a form</div></form>", "t\nwhole page in a form"),
        ("<div role=navigation>no</div><div hidden>no</div><div style='display: none'>no</div><div>yes</div>", "yes"),
        ("<p>a</b></i></p></div></article>b", "a\nb"),
        ("<p class='x>y'>a</p><p class=x\">b</p><a href=\"q>r\">c</a>", "a\nb\nc"),
        ("<svg><p>a</p>", "a"),
        ("<P>A</P><BR/><IMG SRC=x>B", "A\nB"),
        ("<p>　a\xa0b </p><p> \xa0 </p>", "a b"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_parser(page, text):
    assert read(page) == text


def test_deep_and_long_pages():
    assert read("<div>" * 20000 + "x" + "</div>" * 20000 + "y") == "x\ny"
    assert read("<b>" * 20000 + "x") == "x"
    assert read("<" * 50000 + "x") == "<" * 49999 and read("<svg>" * 20000 + "x") == "x"
    page = "<article>" + "<p>w</p><ul><li>x</li></ul>" * 3000 + "</article>"
    wrapper = dom.Wrapper([page])
    root = dom.parse(page.replace("<p>w</p>", "<p>v</p><h2>h</h2>"))
    assert len(wrapper.align(root)) >= 6000 - 1 and read(page).count("\n") == 5999


def best_sum(weight, rows, columns):
    table = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i, j in itertools.product(range(len(rows)), range(len(columns))):
        table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weight[rows[i], columns[j]])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1, 12, 1 << 22])
def test_match_is_the_best_alignment(monkeypatch, cells):
    monkeypatch.setattr(dom, "CELLS", cells)
    rng = np.random.default_rng(1)
    for _ in range(150):
        weight = rng.integers(0, 4, (4, 5)) * (rng.random((4, 5)) < 0.6)
        rows, columns = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        pairs = dom.match(weight, rows, columns)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs))
        assert sum(weight[rows[i], columns[j]] for i, j in pairs) == best_sum(weight, rows, columns)


def tree_match(a, b):
    """Simple tree matching by its definition, over groups of neighbours of one label."""
    if a.label != b.label:
        return 0
    x, y = dom.groups(a.kids), b.kids
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(y))):
        table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + tree_match(x[i][0], y[j]))
    return 1 + table[-1][-1]


def test_alignment_equals_simple_tree_matching():
    rng = random.Random(2)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 3 else rng.choice('xyz')}</{t}>" for t in (rng.choice(["div", "section", "ul"]) for _ in range(rng.randint(1, 3))))

    def shared(root, wrapper):
        owner = {}
        stack = [(wrapper.root, ())]
        while stack:
            slot, path = stack.pop()
            owner[slot.number] = (*path, slot.label)
            stack += [(k, (*path, slot.label)) for k in slot.kids]
        found = wrapper.align(root)
        stack = [(root, ())]
        while stack:  # each leaf lies in a slot below the same elements
            node, path = stack.pop()
            if id(node) in found:
                assert owner[found[id(node)].number] == (*path, "#")
            stack += [(k, (*path, node.label)) for k in node.kids]
        return len(found)

    for _ in range(60):
        a, b = page(), page()
        root, wrapper = dom.parse(a), dom.Wrapper([b])
        assert (shared(root, wrapper) > 0) <= (tree_match(root, wrapper.root) > 1)
        same = dom.parse(b)
        assert len(wrapper.align(same)) == sum(1 for _ in re.finditer(r"[xyz]", b))


def site(rng, host, n, first, template):
    rows, wanted = [], {}
    for k in range(n):
        blocks = [" ".join(rng.choice(["ab", "cd &amp; e", "fg", "hij", "kl"]) + str(rng.randrange(999)) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]
        rows.append((first + k, f"https://{host}/{k}", template(blocks, k), "old", "h", "h2", 1))
        wanted[first + k] = "\n".join(entities.unescape(b) for b in blocks)
    return rows, wanted


def plain(blocks, k):
    """No article element and no telling names; a notice on two pages of three."""
    notice = "<div class=box>Welcome to our site, dear reader</div>" if k % 3 else ""
    return f"<html><body><div class=top><span>My site</span></div>{notice}<div class=x>" + "".join(f"<p>{b}</p>" for b in blocks) + "<p>Read more of our stories</p></div><div class=y>All rights of this site are held</div></body></html>"


def marked(blocks, k):
    return f"<body><nav><a>n{k}</a></nav><article>" + "".join(f"<p>{b}" for b in blocks) + f"<p>Sign up now!</article><div class=ad>ad {k}</div><footer>f {k}</footer>"


def pages(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for host, n, template in (("a.example", 40, plain), ("b.example", 60, marked), ("c.example", 3, lambda b, k: "<main>" + "<br>".join(f"<p>{x}</p>" for x in b) + "</main>")):
        some, texts = site(rng, host, n, len(rows) + 100, template)
        rows += some
        wanted |= texts
    article = "<article><p>the same article</p><p>on many pages</p></article><footer>x</footer>"
    rows += [(1000 + k, "http://Copies.example/x", article, None, "h", "h2", 1) for k in range(50)]
    wanted |= {1000 + k: "the same article\non many pages" for k in range(50)}
    near = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(10)]
    for k in range(50):  # near copies, which differ in one block of ten
        rows.append((1100 + k, "http://near.example/x", "<article>" + "".join(f"<p>{x}</p>" for x in [*near[: k % 10], f"own {k}", *near[k % 10 + 1 :]]) + "</article>", None, "h", "h2", 1))
        wanted[1100 + k] = "\n".join([*near[: k % 10], f"own {k}", *near[k % 10 + 1 :]])
    rows += [(1, "https://a.example/none", None, "t", "h", "h2", 1), (2, None, "<p>no host</p>", "t", "h", "h2", 1), (3, "no-scheme", "", None, "h", "h2", 1), (None, "https://b.example/", "<article>null id</article>", None, None, None, None)]
    wanted |= {1: "", 2: "no host", 3: "", None: "null id"}
    rows += rows[10:12]
    return spark.createDataFrame(rows, SCHEMA), rows, wanted


@pytest.mark.parametrize("small", [False, True])
def test_sites(spark, monkeypatch, small):
    if small:  # wrappers meet their pages by a shuffle, hosts are split, counts leave tasks early, wrappers are parsed again
        for name, value in (("WRAPPER_BYTES", 0), ("PART_PAGES", 7), ("HELD", 3), ("KEPT_BYTES", 10), ("KEYS", 0)):
            monkeypatch.setattr(main_text, name, value)
    df, rows, wanted = pages(spark)
    got = main_text.extract(df.repartition(5), main_text.learn(df))
    assert got.columns == [c for c in df.columns if c != "text"] + ["text"]
    found = sorted(((r.page_id, r.text) for r in got.collect()), key=repr)
    assert found == sorted(((r[0], wanted[r[0]]) for r in rows), key=repr)
    assert {(r.page_id, r.host, r._host, r.constant) for r in got.collect()} == {(r[0], r[4], r[5], r[6]) for r in rows}


def test_query_reads_every_article(spark):
    """Against the test pages' own form: one article of a heading and paragraphs, some of them left open."""
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries.op13_html_text(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    found = got.collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^<>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_empty_tables(spark):
    df = pages(spark)[0].limit(0)
    assert main_text.extract(df, main_text.learn(df)).count() == 0
    some = pages(spark)[0]
    assert main_text.extract(some, main_text.learn(df)).count() == some.count()
