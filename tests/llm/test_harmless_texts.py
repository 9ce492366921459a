"""op10 leaves addresses, dates, numbers and names of files alone and finds planted keys, trained on the given documents."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from strandspark.llm import secrets
from strandspark.llm.common import utf8

LOW = "abcdefghijklmnopqrstuvwxyz"
HARMLESS = ["//www.example.com/articles/2024/05/some-long-title-of-it.html", "https://cdn.static-site.org/assets/js/main.min.js", "123e4567-e89b-12d3-a456-426614174000", "123456789012345", "3.141592653589793", "2024-05-06T12:30:00Z", "2024-05-06T12", "+1-202-555-0143", "0049.30.12345678", "10.1000/j.jmb.2019.02345", "10.1038/s41586-020-2649-2", "978-3-16-148410-0", "IMG_20240506_123456.jpg", "1.2.3-beta.4-20240506", "INV-2024-000123", "snake_case_identifier_name", "internationalization", "/usr/local/lib/python3.11/site-packages", "192.168.100.200.255", "report-2024-Q3-final_v2.xlsx", "user.name123"]


@pytest.fixture(scope="module")
def trained():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[:7000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts[:5000], pa.string())], ["doc_id", "text"])
    seen, labels, digits = ([x for out in secrets._examples([batch]) for x in out.column(k).to_pylist()] for k in range(3))
    r = random.Random(3)
    order = list(range(len(labels)))
    r.shuffle(order)
    chosen = [k for want in ((0, True), (0, False)) for k in [k for k in order if (labels[k], digits[k]) == want][:3000]] + [k for k in order if labels[k] == 1][:3000]
    net = secrets.train(np.array([np.frombuffer(seen[k], np.int16) for k in chosen]), np.array([labels[k] for k in chosen]))
    return net, [t or "" for t in texts[5000:]], r


def added(net, texts):
    return np.array([any(kind == 3 for kind, _, _ in places) for _, places in secrets._places(*utf8(pa.array(texts)), net)])


def planted(make, rest, r, many):
    around = lambda: r.choice(rest)[50:90].replace("\n", " ")
    return [f"{around()} {make()} {around()}" for _ in range(many)]


def test_harmless_texts_stay(trained):
    net, rest, r = trained
    share = [added(net, planted(lambda h=h: h, rest, r, 10)).mean() for h in HARMLESS]
    assert np.mean(share) < 0.1 and sum(x > 0.5 for x in share) <= 1


def test_other_documents_stay(trained):
    net, rest, _ = trained
    assert added(net, rest).mean() < 0.01


@pytest.mark.parametrize(("letters", "prefix"), [("0123456789ABCDEF", ""), (LOW + LOW.upper() + "0123456789", ""), (LOW + "0123456789", ""), (LOW + LOW.upper() + "0123456789", "ghp_"), (LOW + LOW.upper() + "0123456789+/", "")])
def test_planted_keys_are_found(trained, letters, prefix):
    net, rest, r = trained
    assert added(net, planted(lambda: prefix + "".join(r.choice(letters) for _ in range(32)), rest, r, 100)).mean() > 0.85


def test_threshold_puts_recall_first():
    score, truth = np.array([0.1, 0.2, 0.5, 0.6, 0.7, 0.9, 0.95, 0.99]), np.array([0, 1, 0, 1, 1, 0, 1, 1])
    assert secrets.threshold_of(score, truth, 1.0, 0.0) == 0.2
    assert secrets.threshold_of(score, truth, 0.8, 0.4) == 0.6
    assert secrets.threshold_of(score, truth, 0.4, 0.0) == 0.95


def test_forms_are_as_they_should_be():
    rng = np.random.default_rng(1)
    made = [secrets.harmless(["alpha", "beta"], rng) for _ in range(500)]
    assert len(set(made)) > 400 and all(made) and not any("\n" in m for m in made)
    assert secrets.harmless_windows(np.zeros((0, 72), np.int16), rng, 5).shape == (0, 72)
