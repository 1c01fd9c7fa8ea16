import re

import pytest

from granary.llm import html

PAGE = "page_id long, url string, html string, text int, host string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], PAGE)
    return {r.page_id: r.text for r in html.extract(df).collect()}


def text(page):
    return "\n\n".join(t for t, _ in html.parse(page)[0])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T &amp; x</h1><p><b>A b<br>c\n d<p>E &lt;i&gt; &am &#233;</article><footer>f</footer>", "T & x\n\nA b c d\n\nE <i> &am é"),
        ('<head><title>t</title><script>var a="</p><article>x</article>";</script></head><body><nav><ul><li><a>m</a></ul></nav><div class="ad">buy</div>free text<div id="main"><p>one</p>two</div></body>', "free text\n\none\n\ntwo"),
        ("<body><header>h</header><main><header><h1>Title</h1></header><p>x<aside>s</aside>y<form>f<input></form></p><div class='user-comments'><p>c</p></div></main><p>out</p>", "Title\n\nx\n\ny"),
        ("<p>a < b and 3>2</p><!-- c <p>no</p> --><p hidden>h</p><table><tr><td>1</td><td>2</td></tr><tr><td>3</table>", "a < b and 3>2\n\n1 2\n\n3"),
        ('<div class="cookie-notice">ok?</div><p title="a > b">quoted</p><style>p{}</style><p>last', "quoted\n\nlast"),
        ("", ""),
        ("just text", "just text"),
        ("<article><p>unclosed <a href='x'>link", "unclosed link"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://one.example/{i}", f'<body><div class="top"><span>Our site</span> slogan</div><div class="x"><p>story {i}</p></div><div class="low"><p>All about us</p></div></body>') for i in range(12)]
    rows += [(100, "http://two.example/1", '<body><div class="top">Our site</div><p>alone</p></body>')]
    rows += [(200 + i, "http://same.example/1", '<body><div class="top">Copied</div><p>page</p></body>') for i in range(20)]
    got = run(spark, rows)
    assert all(got[i] == f"story {i}" for i in range(12))
    assert got[100] == "Our site\n\nalone" and got[205] == "Copied\n\npage"


def test_style_tree_like_brute_force(spark):
    """Pages, importance and removal of every node, from pages whose nodes the test makes itself."""
    import math
    import random
    from collections import Counter, defaultdict

    import xxhash

    rng, rows, seen = random.Random(6), [], defaultdict(set)
    for i in range(120):
        host = rng.choice(["one.example", "two.example"])
        top, kids = rng.choice(["Site", "Site", "Site", "Other"]), [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 3))]
        low = "Imprint" if host == "one.example" else f"note {i}"
        page = f'<body><div class="top">{top}</div><div class="mid">{"".join(f"<p>{k}</p>" for k in kids)}</div><section>{low}</section></body>'
        rows.append((i, f"http://{host}/{i}", page))
        body = " ".join([top, *kids, low])
        nodes = {"": (("body.",), body), "/body.": (("div.top", "div.mid", "section."), body), "/body./div.top": ((), top), "/body./div.mid": (("p.",) * len(kids), " ".join(kids)), "/body./section.": ((), low)}
        if kids:
            nodes["/body./div.mid/p."] = ((), " ".join(kids))
        for path, (children, content) in nodes.items():
            seen[host, path].add((page, children, content))

    def share(values):
        n = Counter(values)
        total = sum(n.values())
        return -sum(c / total * math.log(c / total) for c in n.values()) / math.log(total) if total > 1 else 1.0

    def key(path):
        return xxhash.xxh64_intdigest(path) - 2**63

    want = {(h, key(p)): (len(pages), round(share([x[1] for x in pages]), 6), round(share([x[2] for x in pages]), 6)) for (h, p), pages in seen.items()}
    tree = html.style_tree(html.parsed_pages(spark.createDataFrame([(url.split("/")[2], page) for _, url, page in rows], "host string, html string")))
    assert {(r.host, r.path): (r.pages, round(r.presentation, 6), round(r.content, 6)) for r in tree.collect()} == want
    section, top = key("/body./section."), key("/body./div.top")
    gone = {k for k, (n, *both) in want.items() if n >= html.MIN_PAGES and max(both) < html.LOW_IMPORTANCE}
    assert gone == {("one.example", section), ("one.example", top), ("two.example", top)}
    assert {(r.host, r.path) for r in html.low_nodes(tree).collect()} == gone
    got = run(spark, rows)
    for i, url, page in rows:
        kept = re.findall("<p>(.*?)</p>", page) + ([f"note {i}"] if "two." in url else [])
        assert got[i] == "\n\n".join(kept)


def test_template_slots_without_structure_go(spark):
    """The tree alone decides: no element or class is in a list, every text differs, and only structures tell."""
    slots = '<div class="a"><ul><li>x{0}</li><li>y{0}</li></ul></div><div class="b">buy {0}</div>'
    story = "".join
    rows = [(i, f"http://one.example/{i}", f'<body>{slots.format(i)}<h1>Title {i}</h1><div class="c">{story(f"<p>t{i} {k}</p>" for k in range(1 + i % 11))}</div><div class="d">by {i}</div></body>') for i in range(40)]
    rows += [(100 + i, f"http://two.example/{i}", rows[i][2]) for i in range(html.MIN_PAGES - 1)]
    rows += [(200 + i, f"http://flat.example/{i}", f'<body><div class="b">one {i}</div><div class="c">two {i}</div></body>') for i in range(20)]
    got = run(spark, rows)
    for i in range(40):
        assert got[i] == "\n\n".join([f"Title {i}", *(f"t{i} {k}" for k in range(1 + i % 11))])
    assert got[100].startswith("x0\n\ny0\n\nbuy 0\n\nTitle 0") and got[203].split("\n\n") == ["one 3", "two 3"]


def test_article_stays_beside_a_richer_slot(spark):
    """Elements that hold an article are never slots to remove; list words still decide on hosts of a few pages."""
    rows = [(i, f"http://one.example/{i}", f'<body><div class="w"><article>story {i}</article></div><div class="z">{"<p>n</p>" * i}{i}</div></body>') for i in range(20)]
    rows += [(100, "http://few.example/", '<body><nav>menu</nav>a <span class="ad">buy</span> b<b><div class="ad">c</b>d</body>')]
    got = run(spark, rows)
    assert all(got[i] == f"story {i}" for i in range(20))
    assert got[100] == "a b\n\nd"


def test_article_text_with_common_words_stays(spark):
    page = "<article><p class='related'>a</p><p><label>b</label> c</p><p class='copyright share'>d</p></article>"
    assert text(page) == "a\n\nb c\n\nd"


def test_plain_article_text_stays(spark):
    rows = [(i, "http://one.example/", f"<article><h1>Same</h1><p>{i}</p><div class='tail'>Read more</div></article>") for i in range(12)]
    assert run(spark, rows) == {i: f"Same\n\n{i}" for i in range(12)}


def test_edges(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://a/", "<p>x</p>"), (4, "http://a/", "<p>x</p>"), (4, "http://a/", "<p>x</p>"), (5, "http://a/", "<p>" + "long " * 50_000 + "</p>")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], PAGE)
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == 6 and {r.page_id: r.n_chars for r in out} == {1: 0, 2: 0, None: 1, 4: 1, 5: 249_999}
    assert html.extract(df.limit(0)).count() == 0


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    import html as refs

    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html).group(1)
        want = [" ".join(refs.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)
