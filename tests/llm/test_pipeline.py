import os
import random

import __spark_entry__ as entry
import corpus_pipeline
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from strandspark.llm import secrets, toxicity
from test_near_dedup import brute
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with toxic texts, near copies, leaks and secrets, with nulls, repeats, empty and long texts and clashing names."""
    folder, r = str(tmp_path_factory.mktemp("tables")), random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([2, 4, 7]))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(k, text(n)) for k, n in enumerate([3, 6, 12, 30, 60])] + [(7, None), (None, "x y z"), (8, "")]
    rows, labels = [], []
    for k in range(260):
        t = text(r.choice([10, 40, 120]))
        if k % 5 == 0:
            t = " ".join(w if n % 8 else r.choice(["blorgish", "snarkel", "blorgishes"]) for n, w in enumerate(t.split()))
        if k % 11 == 3:
            own = bench[k % 5][1].split()
            own[len(own) // 2] = "other" if len(own) >= 5 else own[len(own) // 2]
            t += " " + " ".join(own)
        if k % 13 == 4:
            t += f' token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" ' + text(5)
        rows.append((k, t))
        labels.append((k, int(k % 5 == 0)))
    rows += [(300 + k, rows[k][1].rsplit(" ", 1)[0] + " end") for k in range(0, 60, 2)] + [(400, rows[1][1])] * 2
    rows += [(500, None), (501, ""), (None, text(20)), (None, None), (502, text(3) + " " + "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_against_brute_force(spark, tables, tmp_path):
    """Each stage on what the one before kept, then all of them at once."""
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "toxicity":
            model = toxicity.learned(docs, spark.read.parquet(f"{tables}/labels.parquet"), ~toxicity.held_out())
            expected = [(k, t) for k, t in before if round(plain.toxicity_score(model, t), 6) < 0.7]
            assert sum("blorgish" in (t or "") or "snarkel" in (t or "") for _, t in expected) < 5 < len(before) - len(expected)
        elif name == "near_dedup":
            named = {}
            for k, t in before:
                named.setdefault(k, t)
            component = brute([(k, t) for k, t in named.items() if k is not None], 5, 80)
            expected = [(k, t) for k, t in before if k is None or component[k][2]]
        elif name == "decontaminate":
            expected = [(k, t) for k, t in before if not any(i is not None and item and plain.leaks(item, (t or "")[:20_000]) for i, item in bench)]
        elif name == "secrets":
            net, expected = secrets.learned(docs), []
            for k, t in before:
                spans = sorted([(a, b) for a, _, b in plain.rule_spans(t or "")] + (plain.model_spans(net, t) if t and len(t) < 20_000 else []))
                out, at = "", 0
                for a, b in spans:
                    out += t[at:a] + "[secret]" if a >= at else ""
                    at = max(at, b)
                expected.append((k, out + t[at:] if spans else t))
            assert sum("[secret]" in (t or "") for _, t in expected) >= 5
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            expected = [(k, t.encode(x or "", add_special_tokens=False).ids) for k, x in before]
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
        got = [(r[0], r[1]) for r in docs.select("doc_id", "ids" if name == "bpe" else "text").collect()]
        assert sorted(got, key=str) == sorted(expected, key=str), name
        kept.append(len(got))
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < kept[0]
    whole = [(r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, tables).collect()]
    assert sorted(whole, key=str) == sorted(got, key=str)


def test_stages_on_empty_tables(spark, tables, tmp_path):
    for name in os.listdir(tables):
        spark.read.parquet(f"{tables}/{name}").where("false").write.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= docs.count()


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
