"""op11: tokens of two tokenizers against the libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandspark.llm import alignment
from strandspark.llm.subwords import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(-1, None), (-2, ""), (-3, " "), (-4, "a▁b"), (-5, "<|endoftext|> <s> <0x41>"), (None, "x  y   z    \n\t q  "), (-7, "é́ ﬁ ｱ\x00   x"), (-8, "a" * 5000), (-8, "a" * 5000), (-9, "\n"), (-10, "日本語テキスト。 ok"), (-11, "same words same words")]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    of = {c: b for b, c in enumerate(byte_characters())}
    model = SentencePieceProcessor(model_file=B)

    def both(text):
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw_a = [bytes(of[c] for c in tokenizer.id_to_token(i)) for i in a]
        raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        return (a, b, raw_a, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])

    return both


def places(raw):
    ends = np.cumsum([0, *map(len, raw)]).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def plain(rows, both):
    """The contract's columns, every pair of tokens compared."""
    count, per = Counter(), []
    for doc_id, text in rows:
        a, b, raw_a, raw_b = both(text) if text else ([], [], [], [])
        at_a, at_b = places(raw_a), places(raw_b)
        links, low = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[low][1] <= s:
                low += 1
            j = low
            while j < len(b) and at_b[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, edges = [], sorted({e for _, e in at_a} & {e for _, e in at_b})
        for s, e in zip([0, *edges], edges, strict=False):
            inside = lambda ids, at, s=s, e=e: ",".join(str(x) for x, (p, q) in zip(ids, at, strict=True) if s <= p and q <= e)
            groups.append(f"{inside(a, at_a)}|{inside(b, at_b)}")
        count.update(links)
        per.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, n, m, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for i, n, m, g, links in per]


@pytest.mark.parametrize("most", [1 << 19, 40, 0])
def test_rows_against_plain_loops(spark, small, libraries, most):
    """All texts of the smallest table and odd ones; with a head of 40 pairs or none all other links are joined."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("n_chars < 1500").unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in alignment.summaries(docs, A, B, most).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, libraries), key=str)


def test_lists_and_groups(spark, libraries):
    """Ids are those of the libraries, groups add up to them; clashing and extra columns change nothing."""
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, a int, row string")
    for r, (_, text) in zip(alignment.aligned(docs, A, B).collect(), ROWS, strict=True):
        a, b, _, _ = libraries(text) if text else ([], [], [], [])
        assert (r["a"], r["b"]) == (a, b)
        assert (sum(r["group_a"]), sum(r["group_b"])) == (len(a), len(b)) and all(x > 0 for x in [*r["group_a"], *r["group_b"]])


def test_empty_table(spark):
    assert alignment.summaries(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_any_size_give_one_merge(x, y, work):
    a, b = (np.array(sorted(s | {60}), np.int64) for s in (x, y))
    link_a, link_b, group_a, group_b = alignment.merge_path(a, b, work)
    span = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(i, j) for i, (s, e) in enumerate(span(a)) for j, (p, q) in enumerate(span(b)) if s < q and p < e]
    assert a[group_a - 1].tolist() == b[group_b - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    both = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    assert alignment.crossings(a, b, np.arange(len(both) + 1)).tolist() == [sum(side == 0 for _, side in both[:d]) for d in range(len(both) + 1)]


def test_chunks_of_pieces(libraries):
    """Texts cut at spaces give the ids of whole texts, also in one call with others."""
    texts = ["a  b   c    d", "tabs\t and\n lines \n  x", "", "end ", "ünï  ↑ 🎉  x", "word"]
    ids_a, rows_a, ids_b, rows_b = alignment.encoded(pa.array([*texts, None]), A, B)
    for k, t in enumerate(texts):
        a, b, _, _ = libraries(t) if t else ([], [], [], [])
        assert ids_a[rows_a[k] : rows_a[k + 1]].tolist() == a and ids_b[rows_b[k] : rows_b[k + 1]].tolist() == b
