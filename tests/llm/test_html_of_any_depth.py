"""op4 on pages that are deep, unclosed or in other languages, and extraction against all labellings of small pages."""

import itertools
import time

import numpy as np
import pytest
from strandspark.llm import html_text

FILL = "A sentence of the article that is long enough to tell what it is, with a full stop. "
MEGABYTES = {
    "nested": "<div>x " * 150_000,
    "unclosed": "<a " * 330_000,
    "closed at the end": "<a " * 330_000 + ">",
    "no end tags": "<title>" * 140_000,
    "inline and blocks": "<b>" * 50_000 + "<p>x</p>" * 50_000,
    "ends of nothing": "<div>" * 50_000 + "</x>y" * 100_000,
    "hidden": "<div hidden>" * 40_000 + "<p>y" * 50_000 + "</div>" * 4_000,
    "never ended": "<noscript>x" * 90_000,
    "quotes": '<a b="> ' * 100_000,
}


@pytest.mark.parametrize("name", sorted(MEGABYTES))
def test_a_megabyte_takes_seconds(name):
    began = time.time()
    html_text.main_text(MEGABYTES[name], html_text.PRIOR)
    assert time.time() - began < 15


def test_time_grows_with_the_page():
    """Four times the depth may take about four times as long, not sixteen times."""
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        html_text.blocks("<div>x <b>" * n)
        took.append(time.time() - began)
    assert took[1] < 9 * max(took[0], 0.05)


@pytest.mark.parametrize("name", ["kommentare", "commentaires", "comentarios", "leserbriefe", "seitenleiste", "barra-lateral", "publicite", "anzeige", "relacionados"])
def test_sections_named_in_other_languages_go(name):
    page = f"<html><body><article class='artikel'><h1>Title of it</h1><p>{FILL * 3}</p></article><section class='{name}'><p>{'I read this and say what I think of it. ' * 4}</p></section></body></html>"
    assert html_text.main_text(page, html_text.PRIOR) == f"Title of it {(FILL * 3).strip()}"


@pytest.mark.parametrize("name", ["artikel-inhalt", "contenu", "contenido", "hauptteil"])
def test_articles_named_in_other_languages_stay(name):
    page = f"<body><div class='{name}'><p>{FILL}</p><p>{FILL}</p></div><div class='fusszeile'><p>{FILL}</p></div></body>"
    assert html_text.main_text(page, html_text.PRIOR) == f"{FILL}{FILL}".strip()


def plain_text(page, weights, near=0.4, kin=0.4):
    """The cheapest of all labellings, from blocks, features and distances worked out by walking up the tree."""
    found = html_text.blocks(page)
    gain = html_text.features(found) @ weights

    def path(e):
        out = []
        while e.parent is not None:
            out.append(e)
            e = e.parent
        return out[::-1]

    paths = [path(e) for _, e, _ in found]
    edges, last = [], {}
    for k, p in enumerate(paths):
        if k:
            same = sum(1 for a, b in zip(p, paths[k - 1], strict=False) if a is b)
            edges.append((k - 1, k, near / (1 + len(p) + len(paths[k - 1]) - 2 * same)))
        parent = id(p[-2]) if len(p) > 1 else 0
        if parent in last and last[parent] != k - 1:
            edges.append((last[parent], k, kin))
        last[parent] = k
    best = min(itertools.product((False, True), repeat=len(found)), key=lambda keep: (round(sum(max(0, g) for g, x in zip(gain, keep, strict=True) if not x) + sum(max(0, -g) for g, x in zip(gain, keep, strict=True) if x) + sum(c for a, b, c in edges if keep[a] != keep[b]), 9), keep))
    return " ".join(t for (t, _, _), x in zip(found, best, strict=True) if x)


def test_extraction_against_all_labellings():
    """Small pages of random elements: what is kept is the cheapest labelling of all."""
    rng = np.random.default_rng(4)
    pieces = ["<p>", "</p>", "<div>", "</div>", "<div class='post'>", "<article>", "</article>", "<nav>", "</nav>", "<ul><li>", "</ul>", "<a href='/x'>link text</a>", "<h2>Head</h2>", FILL, "Short words", "<section class='comments'>", "</section>", "<footer>© all rights</footer>"]
    seen = 0
    for _ in range(300):
        page = "".join(pieces[k] for k in rng.integers(len(pieces), size=14))
        if len(html_text.blocks(page)) <= 9:
            seen += 1
            assert html_text.main_text(page, html_text.PRIOR) == plain_text(page, html_text.PRIOR)
    assert seen > 200
