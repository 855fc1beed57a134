"""Pages with forms, thin neighbours and broken markup, and the densities against a direct computation."""

import math
import time

import pytest

from barwise.llm import pages
from barwise.llm.pages import main_text

PROSE = "A long paragraph of prose that goes on about the matter at hand for quite a while, with commas and all. " * 4


def test_short_prose_beside_the_core_stays():
    body = f"<div><h1>Title</h1><p>Short intro.</p></div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>End.</p></div>"
    links = "<div>" + "".join(f"<a href='{i}'>Other story {i}</a> " for i in range(9)) + "</div>"
    rights = "<div>© 2024 Some House. All rights reserved.</div>"
    got = main_text(f"<body>{links}{body}{links}{rights}</body>").split("\n")
    assert got == ["Title", "Short intro.", *[PROSE.strip()] * 3, "End."]


def test_form_around_the_page():
    page = f"<form id=f action=x><input type=hidden name=v><div><div>{PROSE}</div><div>{PROSE}</div><label>Name</label><button>Go</button></div></form>"
    assert main_text(f"<html><body>{page}</body></html>") == "\n".join([PROSE.strip()] * 2)
    small = "<form><p>Your address will not be shown.</p><label>Name</label><input></form>"
    assert main_text(f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div>{small}</body>") == "\n".join([PROSE.strip()] * 2)


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a =\"><b \"" * 100_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</b>" * 50_000,
    "<p><button>" + "<b>" * 50_000 + "<hr>" * 50_000, "<article>" * 50_000 + "x", "<div>" * 30_000 + "<header>h</header>" * 30_000,
    "<" * 1_000_000, "<!-- " * 200_000, "<script>" * 100_000, "</p>" * 200_000, "<ul>" + "<li><b>" * 50_000,
])
def test_broken_pages_end(page):
    start = time.process_time()
    main_text(page + "<p>tail</p>")
    assert time.process_time() - start < 20  # a fraction of it here; quadratic work would take hours


def test_quotes_and_ends():
    assert main_text("<p title=\"a > b\">one</p><p title='>'>two</p><p data-x=\">three</p>") == "one\ntwo\nthree"
    assert main_text("<p>a < b <3 and <b>c</b> </ d><p>e</i></p>f<") == "a < b <3 and c </ d>\ne\nf<"
    assert main_text("<p>kept<!-- dropped --> too <!-- open <p>gone") == "kept too"


def test_density_formula():
    page = f"<body><div><p>{PROSE}</p><p>With <a href=x>one link</a> and more words here.</p><ul><li><a>only</a></li></ul></div><p>Tail.</p></body>"
    root = pages.parse(page)
    nodes = pages._ordered(root)
    pages._measure(nodes)
    body = next(n for n in nodes if n.tag == "body")
    inside = pages._ordered(body)
    pages._densities(inside, body)

    def figures(node):
        """(characters, tags, characters in links, tags in links) below an element, by recursion."""
        c = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        t = lc = lt = 0
        for child in node.children():
            a, b, d, e = figures(child)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        return (c, t, c, t + 1) if node.tag == "a" else (c, t, lc, lt)

    bc, _, blc, _ = figures(body)
    for node in inside:
        c, t, lc, lt = figures(node)
        one = lambda x: max(x, 1)
        base = math.log(c / one(c - lc) * lc + blc / bc * c + math.e) if c else 0
        want = c / one(t) * max(math.log(c / one(lc) * one(t) / one(lt)), 0) / math.log(base) if c and base > 1 + 1e-12 else node.density
        assert node.density == pytest.approx(want), node.tag
        assert node.total == pytest.approx(sum(ch.density for ch in node.children())), node.tag
