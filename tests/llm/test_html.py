import math
import random
import time

import pytest

from codequarry.llm import html_text

LONG = "Some longer sentence that holds the story of the page and goes on for a while. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>a<p>b", "a\n\nb"),
        ('<div class="ad">x</div>', ""),
        ('<div><h1>T</h1><p>Hello <b>w</b>orld</p><p>x<br>y</p><div class="comments"><p>bad</p></div></div>', "T\n\nHello world\n\nx y"),
        ("<body><header>H</header><main><p>one</p></main><form>f</form>", "one"),
        ("<table><tr><td>a<td>b</table>", "a\n\nb"),
        ("<<<>>", "<<<>>"),
        ('<p title="a>b">ok</p>', "ok"),
        ("<script>x", ""),
        ("<p>a&nbsp;&#233;&eacute;  \n\t b</p>", "a éé b"),
        ("<article><p>one</p><nav>n</nav><p>two</p></article><footer>f</footer>", "one\n\ntwo"),
        ("<p>a</p><!-- <p>no</p> --><![CDATA[c]]>", "a\n\nc"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_article_among_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div id="cookie-banner">We use cookies</div>
<aside class="sidebar"><p>{LONG}</p></aside><article><h1>Title</h1><p><b>{LONG}<br><p>{LONG}{LONG}</p></article>
<section class="comments"><p>{LONG}</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == f"Title\n\n{LONG.strip()}\n\n{(LONG + LONG).strip()}"


def test_density_finds_text_without_marks():
    links = "".join(f'<li><a href="/{i}">Link number {i} here</a></li>' for i in range(30))
    page = f"<html><body><div><ul>{links}</ul></div><div><div><p>{LONG * 3}</p><p>{LONG * 4}</p></div></div></body></html>"
    assert html_text.main_text(page) == f"{(LONG * 3).strip()}\n\n{(LONG * 4).strip()}"


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-sidebar", "sidebar"])
def test_names_do_not_cut_the_article(name):
    page = f'<body><div class="menu"><p>m</p></div><div id=content class={name}><h1>T</h1><p>{LONG * 3}</p><p>{LONG * 4}</p></div></body>'
    assert html_text.main_text(page) == f"T\n\n{(LONG * 3).strip()}\n\n{(LONG * 4).strip()}"


def test_named_headings_and_sections_stay():
    page = f"<article><h2 id=related-work>A</h2><p>{LONG * 3}</p><h2 class=related>B</h2><section id=search-and-discussion><p>{LONG}</p></section><div class='x comments'><p>no</p></div></article>"
    assert html_text.main_text(page) == f"A\n\n{(LONG * 3).strip()}\n\nB\n\n{LONG.strip()}"


def test_formulas_and_objects_stay():
    page = f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> so</p><object data=a><p>fallback</p></object></article>"
    assert html_text.main_text(page) == f"{LONG}x=1 so\n\nfallback"


def test_linked_headings_paragraphs_and_references_stay():
    references = "".join(f"<li><a href=#r{i}>On the title of the reference number {i} of many</a></li>" for i in range(3))
    menu = "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(9))
    page = f"<article><h2><a href=#x>Title</a></h2><p>{LONG * 3}</p><p><a href=#y>Alone</a></p><ol>{references}</ol><ul>{menu}</ul></article>"
    want = ["Title", (LONG * 3).strip(), "Alone", *(f"On the title of the reference number {i} of many" for i in range(3))]
    assert html_text.main_text(page).split("\n\n") == want


def test_operator(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, None), (None, "u", "", "y"), (3, "u", f"<article><p>{LONG * 20_000}</p></article>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 5
    assert next(r for r in got if r.page_id == 3).n_chars == len((LONG * 20_000).strip())
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def plain_density(tree, body):
    """Counts and density of (tag, children) by their definitions: characters, tags, link characters, link tags."""

    def chars(n, inside=False, links=False):
        inside = inside or n[0] == "a"
        return sum((len(x.replace(" ", "")) if not links or inside else 0) if isinstance(x, str) else chars(x, inside, links) for x in n[1])

    def tags(n, name=None):
        return sum((name in (None, x[0])) + tags(x, name) for x in n[1] if not isinstance(x, str))

    def link_tags(n):
        return (n[0] == "a") + tags(n, "a")

    c, t, lc, lt = chars(tree), tags(tree), chars(tree, links=True), link_tags(tree)
    if not c:
        return c, t, lc, lt, 0.0
    share = chars(body, links=True) / chars(body)
    low = math.log(1 + math.log(c * lc / max(c - lc, 1) + share * c + math.e))
    return c, t, lc, lt, max(0.0, c / max(t, 1) * math.log(max(c * max(t, 1) / (max(lc, 1) * max(lt, 1)), 1)) / low)


def test_density_of_random_trees():
    rnd = random.Random(4)

    def grow(depth):
        kids = []
        for _ in range(rnd.randint(1, 4)):
            kids.append("w" * rnd.randint(1, 30) + " x" if depth > 4 or rnd.random() < 0.4 else (rnd.choice(["div", "section", "span", "b"]), grow(depth + 1)) if rnd.random() < 0.7 else ("a", ["link " * rnd.randint(1, 5)]))
        return kids

    def page(n):
        return f"<{n[0]}>" + "".join(x if isinstance(x, str) else page(x) for x in n[1]) + f"</{n[0]}>"

    def walk(node, tree, body):
        assert node.tag == tree[0]
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == (want := plain_density(tree, body))[:4]
        assert math.isclose(node.density, want[4], abs_tol=1e-9)
        own = [x for x in node.items if not isinstance(x, str)]
        kids = [x for x in tree[1] if not isinstance(x, str)]
        assert len(own) == len(kids) and math.isclose(node.total, sum(plain_density(k, body)[4] for k in kids), abs_tol=1e-9)
        for a, b in zip(own, kids):
            walk(a, b, body)

    for _ in range(40):
        tree = ("html", grow(0))
        root = html_text.parse(page(tree)[len("<html>") : -len("</html>")])
        html_text._measure(root)
        walk(root, tree, tree)


def test_unclosed_elements():
    assert html_text.main_text("<iframe><p>a</p>") == "a"
    assert html_text.main_text("<div><script>x</div><p>a</p>") == "a"
    assert html_text.main_text("<ul><li><p>a<li>b</ul><table><tr><td>c<tr><td>d</table>") == "a\n\nb\n\nc\n\nd"
    assert html_text.main_text('<p title="a>b</p><p>c</p>') == "b\n\nc"


@pytest.mark.parametrize("piece", ['<a x"', '<a ">"', "<div>", "</span>", "<b><h1>", "<iframe>", '<div class="menu">x</div>', "<li>", "<", "<!--", "<td>"])
def test_hostile_pages_take_linear_time(piece):
    for before, after in (("", ""), ("<span><article>", "</span>" * 5_000), ("<p><table>", "</p>" * 5_000), ("", '"')):
        begin = time.time()
        html_text.main_text(before + piece * (500_000 // len(piece)) + after)
        assert time.time() - begin < 5


BODY = "".join(f"<p>{LONG * 2}</p>" for _ in range(3))
FULL = "\n\n".join([(LONG * 2).strip()] * 3)
REFERENCES = "<ul><li><a href=/a>Smith 2019</a></li><li><a href=/b>Jones 2020</a></li><li><a href=/c>Lee 2021</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id=aspnetForm><input type=hidden><div>{BODY}</div><label>Search</label><button>x</button></form></body>", FULL),
        (f"<body><form><label>Name</label><p>{LONG}</p></form><article>{BODY}</article></body>", FULL),
        (f"<body><form><label>Name {LONG * 9}</label><input></form><p>a</p></body>", "a"),
        (f"<article>{BODY}{REFERENCES}</article>", f"{FULL}\n\nSmith 2019\n\nJones 2020\n\nLee 2021"),
        (f"<body><div>{BODY}{REFERENCES}</div></body>", f"{FULL}\n\nSmith 2019\n\nJones 2020\n\nLee 2021"),
        (f"<body><div class=cookie-banner>We use cookies. {LONG}</div><div>{BODY}</div></body>", FULL),
        (f"<body><div>{BODY}</div><div class=site-footer><p>Copyright 2024. {LONG}</p></div></body>", FULL),
        (f"<body><div id=main-menu><p>Home and News and Sport</p></div><div>{BODY}</div></body>", FULL),
        (f"<article>{BODY}<ol class=comment-list><li><p>{LONG}</p></li><li><p>nice</p></li></ol></article>", FULL),
        (f"<main>{BODY}<div class=related-posts><p>{LONG}</p></div></main>", FULL),
        (f"<article>{BODY}<div class=newsletter-signup><p>Sign up now, {LONG}</p></div></article>", FULL),
        (f"<article>{BODY}<div><p>Buy our thing <a href=/x>here and now</a></p></div></article>", FULL),
        (f"<main><div>{BODY}</div><div><a href=/x>Try our app</a> today</div></main>", FULL),
        (f"<article>{BODY}<p>So <span class=search-hit>it</span> <a href=/x>goes</a></p></article>", f"{FULL}\n\nSo it goes"),
        (f"<article><div class='has-sidebar no-menu'>{BODY}</div></article>", FULL),
        ("<p>&amp<i>lt;</i> &l<i>t;</i> &lt;p&gt;</p>", "&lt; &lt; <p>"),
    ],
)
def test_what_belongs_to_the_article(page, text):
    assert html_text.main_text(page) == text


def test_equal_sums_choose_the_first_in_page_order():
    part = f"<div>{BODY}</div>"
    nav = "".join(f"<p><a href=/{i}>{LONG}</a></p>" for i in range(8))
    root = html_text.parse(f"<body><section>{part}</section><div>{nav}</div><section>{part}</section></body>")
    order = html_text._measure(root)
    best, _ = html_text._chosen(order)
    sums = [n.total for n in order]
    assert order.index(best) == sums.index(max(sums)) and sums.count(max(sums)) > 1


def test_choice_and_threshold_by_their_definitions():
    """On random trees: the subtree is the first of the largest sums, and a block goes exactly if its density and links say so."""
    rnd = random.Random(9)

    def grow(depth):
        kids = []
        for _ in range(rnd.randint(1, 4)):
            if depth > 3 or rnd.random() < 0.35:
                kids.append("<p>" + "word " * rnd.randint(1, 40) + (f"<a href=x>{'link ' * rnd.randint(1, 6)}</a>" if rnd.random() < 0.4 else "") + "</p>")
            else:
                tag = rnd.choice(["div", "section", "ul"])
                kids.append(f"<{tag}>{grow(depth + 1)}</{tag}>")
        return "".join(kids)

    for _ in range(60):
        root = html_text.parse(f"<body>{grow(0)}</body>")
        order = html_text._measure(root)
        best, top = html_text._chosen(order)
        top_sum = max(n.total for n in order)
        assert best.total == top_sum and not any(n.total == top_sum for n in order[: order.index(best)])
        path, node = [], top
        while node is not None:
            path.append(node)
            node = node.parent
        threshold = min(n.density for n in path)
        gone, left = set(), []

        def walk(node, in_best):
            for x in node.items:
                if isinstance(x, html_text.Node):
                    holds, y = False, best
                    while y is not None:
                        holds |= y is x
                        y = y.parent
                    links, rest = x.link_chars, x.chars - x.link_chars
                    if not holds and x.tag in html_text.BLOCK and x.link_tags and x.density < threshold:
                        menu = x.link_tags > 1 and links < 25 * x.link_tags and links > rest
                        inner = x.tag in ("div", "section", "ul") and (menu and x.link_tags >= 5 or x.tag != "ul" and rest > 0 and rest <= 2 * links)
                        if inner if in_best else menu or 3 * links >= rest:
                            gone.add(id(x))
                            continue
                    walk(x, in_best or x is best)
                elif x.strip():
                    left.append(x)

        walk(top, top is best)
        text = "\n\n".join(html_text._blocks(top, best, threshold))
        assert "".join(text.split()) == "".join("".join(left).split())
