import random

import numpy as np

from scorelake.llm import html_blocks as H

PAGES = "page_id bigint, url string, html string, text string, n_chars string"


def gradient(net, x, real, y, name, at):
    def loss():
        p = np.clip(net.chances(x, real), 1e-12, 1 - 1e-12)
        return -np.where(real, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / real.sum()

    v, eps = net.p[name].ravel(), 1e-5
    old = v[at]
    v[at] = old + eps
    up = loss()
    v[at] = old - eps
    down = loss()
    v[at] = old
    return (up - down) / (2 * eps)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = H.Labeller(hidden=3)
    x, real = H.padded([rng.normal(size=(n, net.p["Wf"].shape[0])) for n in (4, 2, 1)])
    y = rng.integers(0, 2, real.shape).astype(float)
    grads = net.gradients(x, real, y)
    for name, g in grads.items():
        for at in rng.integers(0, g.size, 4):
            assert np.isclose(g.ravel()[at], gradient(net, x, real, y, name, at), atol=1e-6), name


def test_blocks():
    page = "<html><head><title>T &amp; t</title><script>var a='</p><p>no';</script></head><body><!-- <p>no</p> --><p>a<b>b</b> c&nbsp;<br>d<p>e &lt;f&gt;<ul><li>x<li>y</ul>tail <a href='/q>r'>link</a></body>"
    got = [(b.path[-1], b.text) for b in H.leaf_blocks(page)]
    assert got == [("title", "T & t"), ("p", "ab c d"), ("p", "e <f>"), ("li", "x"), ("li", "y"), ("body", "tail link")]
    assert H.leaf_blocks(None) == H.leaf_blocks("") == H.leaf_blocks("<p> \n</p>") == []
    assert [b.text for b in H.leaf_blocks("<div>open <p class='x>y'>z")] == ["open", "z"]


def test_held_out_accuracy_on_made_pages():
    rng, net = random.Random(12345), H.trained()
    right = total = 0
    for _ in range(150):
        source, marks = H.made_page(rng)
        blocks = H.leaf_blocks(source)
        if len(blocks) == len(marks):
            got = net.chances(*H.padded([H.vectors(blocks)]))[:, 0] >= 0.5
            right, total = right + (got == np.array(marks)).sum(), total + len(marks)
    assert right / total > 0.98


def test_article_of_a_plain_page(spark):
    body = "".join(f"<p>Paragraph number {k} tells of things, at some length, for readers of the page.</p>" for k in range(6))
    page = f"<html><head><title>Name</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Name</h1>{body}</article><footer>&copy; host</footer></body></html>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, None, None), (2, None, None, None, None), (3, "v", "", None, None), (None, "w", "no tags at all", None, None), (5, "z", "<p>" + "long words here. " * 40_000, None, None)]
    got = H.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    want = "Name " + " ".join(f"Paragraph number {k} tells of things, at some length, for readers of the page." for k in range(6))
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_pages_of_the_tables():
    import html
    import re

    import duckdb

    rows = duckdb.connect().execute("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got, bad = H.main_texts([r[0] for r in rows], H.trained()), 0
    for (page,), text in zip(rows, got):
        inside = page[page.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inside)]
        bad += text != " ".join(b for b in blocks if b)
    assert bad == 0


def test_only_raw_elements_are_left_out():
    texts = lambda page: [b.text for b in H.leaf_blocks(page)]
    article = "<article><p>One.</p><p>Two.</p></article>"
    for ahead in ("<svg-icon></svg-icon>", "<math-renderer>", "<style-guide/>", "<svg width='1'/>", "<svg><path d='x'/>", "<select><option>", "<SVG><svg/><title>no</title></SVG>", "<template><p>no</p></template>", "<script>a</style>b</script>", "<script>1</scripts>2</script >", "<canvas id=c></canvas>"):
        assert texts(ahead + article + "<script>no</script><svg><text>no</text></svg>")[-2:] == ["One.", "Two."], ahead
        if "no" in ahead or "script" in ahead:
            assert texts(ahead + article) == ["One.", "Two."], ahead
    assert texts("<p>so <math><mi>E</mi><mo>=</mo><mn>2</mn></math> holds</p><object data='x'><p>A chart.</p></object>") == ["so E=2 holds", "A chart."]


def test_every_class_name_is_in_the_path():
    names = "flex flex-col md:w-full p-4 m-2 text-sm bg-white border rounded shadow grid gap-2 hidden lg:block sidebar"
    assert ".sidebar" in H.leaf_blocks(f'<div class="{names}">x</div>')[0].path


def test_hidden_elements_and_other_attributes():
    texts = lambda page: [b.text for b in H.leaf_blocks(page)]
    for how in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "style='color:red; display : none'", 'style="visibility:hidden"'):
        assert texts(f"<p>One <span {how}>no</span>two.</p><div {how}><p>no</p>no</div><p {how}>no<p>Three.") == ["One two.", "Three."], how
    for how in ("data-hidden", 'aria-hidden="false"', "class=hidden", "style='--display:none; display:block'", "title='hidden'"):
        assert texts(f"<p {how}>One.</p>") == ["One."], how
    assert H.leaf_blocks("<p data-id='x' data-class=y class=z my-role='w'>t</p>")[0].path == ("p", ".z")


def test_pages_off_the_usual_template():
    line = "This is paragraph {} of the text, and it tells its readers of one thing or another."
    six = "".join(f"<p>{line.format(k)}</p>" for k in range(6))
    want = " ".join(line.format(k) for k in range(6))
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"
    pages = [
        (f"<html><body><div>{six}</div></body></html>", want), (six, want), (f"<html><head><title>A name</title></head><body><article><p>{line.format(1)}</p></article></body></html>", line.format(1)),
        (f"<body><nav>{menu}</nav><div>{six}</div><footer><p>&copy; host, all rights reserved</p></footer></body>", want), (f"<body><svg/><article>{six}</article></body>", want),
        (f"<body><main><p>{line.format(1)}</p><p>{line.format(2)}</p></main><div class='comments'><p>Nice one, thanks for it</p></div></body>", f"{line.format(1)} {line.format(2)}"),
        (f"<body><div hidden>{six}</div><section>{six}</section></body>", want),
    ]
    assert H.main_texts([p for p, _ in pages], H.trained()) == [w for _, w in pages]


def test_tables_columns_and_bare_text():
    """Pages laid out as tables, a second column of links under a heading, menus without links, tables of the article, text without elements."""
    line = "This is paragraph {} of the text, and it tells its readers of one thing or another."
    six = "".join(f"<p>{line.format(k)}</p>" for k in range(6))
    want = " ".join(line.format(k) for k in range(6))
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"
    pages = [
        (f"<body><table><tr><td class=menu>Home Shop</td><td>{six}</td></tr></table></body>", want), (f"<body><div class=menu>Home Shop</div><div>{six}</div></body>", want),
        (f"<body><table><tr><td><a href=/a>Home</a><br><a href=/b>Shop</a></td><td>{six}</td></tr><tr><td colspan=2>&copy; 2020 host</td></tr></table></body>", want),
        (f"<body><table><tr><td>{six}</td><td class=sidebar>Popular things to read</td></tr></table></body>", want),
        (f"<html><head><title>T</title></head><body><table width=100%><tr><td colspan=2 class=header>My site</td></tr><tr><td class=nav>{menu}</td><td class=content><h1>A name</h1>{six}</td></tr><tr><td class=footer>&copy; 2020 host</td></tr></table></body>", f"A name {want}"),
        (f"<body><div class=row><div class=col>{six}</div><div class=col><h3>Most read</h3>{menu}</div></div></body>", want), (f"<body><div>{six}</div><div><h3>Most read</h3>{menu}</div></body>", want),
        (f"<body><main>{six}</main><aside><h2>Most read</h2>{menu}</aside></body>", want), ("no tags at all", "no tags at all"),
        (f"<body><nav>{menu}</nav><article>{six}<table><tr><th>Name</th><th>Size</th></tr><tr><td>One</td><td>5</td></tr></table></article></body>", f"{want} Name Size One 5"),
    ]
    assert H.main_texts([p for p, _ in pages], H.trained()) == [w for _, w in pages]


def test_long_attributes_are_not_kept():
    before = H._short_names.cache_info().currsize
    assert H.leaf_blocks(f"<p class=known data-x='{'y' * 100_000}'>t</p>")[0].path == ("p", ".known")
    assert H._short_names.cache_info().currsize == before


def plain_chances(net, x):
    """The labeller written out number by number: gates in, forget, out, then the new value, forwards and backwards."""
    import math

    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    n, states = net.hidden, {}
    for way in "fb":
        w, u, c0 = (net.p[k + way].tolist() for k in ("W", "U", "c"))
        h, c, out = [0.0] * n, [0.0] * n, {}
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = [c0[j] + sum(x[t][i] * w[i][j] for i in range(len(x[t])) if x[t][i]) + sum(h[i] * u[i][j] for i in range(n)) for j in range(4 * n)]
            c = [sigmoid(z[n + j]) * c[j] + sigmoid(z[j]) * math.tanh(z[3 * n + j]) for j in range(n)]
            h = [sigmoid(z[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
            out[t] = h
        states[way] = out
    v = net.p["v"][:, 0].tolist()
    return [sigmoid(net.p["d"][0] + sum(a * b for a, b in zip(states["f"][t] + states["b"][t], v))) for t in range(len(x))]


def test_forward_pass_against_plain_numbers():
    net = H.Labeller(hidden=4, seed=9)
    pages = [H.vectors(H.leaf_blocks(f"<body><nav class=menu><a href=x>Home</a></nav>{'<p>Some words, here.</p>' * k}<div>5 © x</div></body>")) for k in (1, 4, 2)]
    x, real = H.padded(pages)
    got = net.chances(x, real)
    for k, page in enumerate(pages):
        assert np.allclose(got[: len(page), k], plain_chances(net, page.tolist()))


def parsed_blocks(source):
    """Texts between tags of blocks, cut by another parser."""
    from html.parser import HTMLParser

    class Cutter(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.parts, self.raw = [], [], 0

        def flush(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.raw += 1
            elif tag not in H.INLINE:
                self.flush()
            elif tag == "br":
                self.parts.append(" ")

        def handle_startendtag(self, tag, attrs):
            if tag not in H.INLINE:
                self.flush()
            elif tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.raw -= 1
            elif tag not in H.INLINE:
                self.flush()

        def handle_data(self, data):
            if not self.raw:
                self.parts.append(data)

    cutter = Cutter()
    cutter.feed(source)
    cutter.close()
    cutter.flush()
    return cutter.out


def test_blocks_against_another_parser():
    """On the pages of a table and on made ones, the blocks' texts are those that the standard library's parser gives."""
    import pyarrow.parquet as pq

    rng = random.Random(8)
    tags = ["p", "div", "ul", "li", "h2", "span", "b", "a", "em", "section", "td"]
    made = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag} class='x y'>", f"</{tag}>", "<br>", "<br/>", "<!-- c -->", "<script>if (a < b) x()</script>", "text &amp; more ", " é&nbsp;", "\n  \n", "5 &lt; 6"]))
        made.append("".join(parts))
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for page in [p for p in pages if p] + made:
        assert [b.text for b in H.leaf_blocks(page)] == parsed_blocks(page), page[:300]
