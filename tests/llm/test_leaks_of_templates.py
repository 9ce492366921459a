"""op9 where items are made from one template: the same leaks as brute force, in bounded time and memory."""

import random
import time

import numpy as np
import plain
import pyarrow as pa
import pytest
from strandspark.llm import decontaminate
from strandspark.llm.common import utf8

TEMPLATE = "which of the following statements is true about a given system of linear equations over some field as told here".split()
WORDS = [f"w{k}" for k in range(4000)]


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        kind, at = r.randrange(3), r.randrange(len(words))
        words[at : at + (kind != 1)] = [] if kind == 2 else [r.choice(WORDS)]
    return words


@pytest.mark.parametrize(("common", "own"), [(10, 10), (20, 8), (10, 3), (18, 2), (4, 2)])
def test_leaks_against_brute_force(common, own):
    """More items than may share a piece; texts with the template alone, with items at the allowed edits and beyond them."""
    r = random.Random(common)
    items = [(k, " ".join(TEMPLATE[:common] + [r.choice(WORDS) for _ in range(own)])) for k in range(60)]
    n = common + own
    texts = [" ".join(edited(items[k][1].split(), e, r)) for k in range(12) for e in (0, n // 5, n // 5 + 2)]
    texts += [" ".join(w for _ in range(40) for w in TEMPLATE[:common] + [r.choice(WORDS)]), " ".join(TEMPLATE[:common]), ""]
    texts = [f"before it {t} and after" for t in texts]
    got = {(k, i) for k, i, *_ in decontaminate.Index(items).leaks(*utf8(pa.array(texts)))}
    assert got == {(k, i) for k, t in enumerate(texts) for i, item in items if plain.leaks(item, t)}


def test_many_items_and_many_places():
    """2000 items and a text that has their template 2000 times: 40 million pairs, of which none is made."""
    r = random.Random(1)
    items = [(k, " ".join(TEMPLATE[:10] + [r.choice(WORDS) for _ in range(10)])) for k in range(2000)]
    index = decontaminate.Index(items)
    text = " ".join(w for _ in range(2000) for w in [*TEMPLATE[:10], "filler", "words"])
    began = time.time()
    got = list(index.leaks(*utf8(pa.array([text, f"{text} {items[7][1]}"]))))
    assert [(k, i, d) for k, i, d, *_ in got] == [(1, 7, 0)] and time.time() - began < 20


def test_many_leaks_are_found_once_each():
    """Items that differ in fewer words than may be edited all leak; a stretch that holds them is read once for each."""
    items = [(k, " ".join(TEMPLATE[:10] + [WORDS[k]])) for k in range(300)]
    index = decontaminate.Index(items)
    text = " ".join(w for _ in range(300) for w in [*TEMPLATE[:10], "filler"])
    assert [i for _, i, *_ in index.leaks(*utf8(pa.array([text])))] == list(range(300))
    assert len(list(index.leaks(*utf8(pa.array([text])), any_item=True))) == 1


def test_pieces_lie_apart_and_are_rare():
    r = random.Random(2)
    words = [np.array([1, 2, 3, 4, 5, 6, 7, 8, *(r.randrange(100, 10**9) for _ in range(8))], np.uint64) for _ in range(50)]
    for size, begins in decontaminate.rare_pieces(words, [4] * 50):
        assert len(begins) == 4 and all(b - a >= size for a, b in zip(begins[:-1], begins[1:], strict=True)) and begins[0] + size > 8
