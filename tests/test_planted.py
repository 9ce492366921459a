"""Planted files of every variant, read back by ranges of any size and by plain Python."""

import glob

import pytest
from strandspark.operators.generators import PLANTED
from strandspark.sources import planted, ranges

SCHEMA = "doc_id long, n long, key string, length string"
ROWS = [(k, n, "clash", "clash") for k, n in [(0, 20_000), (1, 0), (2, 1), (3, 7777), (4, 1024 * 50), (5, None), (None, 5), (7, 640)]]


def records(spark, rows=ROWS):
    return planted.weighted(spark.createDataFrame(rows, SCHEMA), "doc_id", "n")


def plainly(path):
    """Headers and symbols of all records, by file."""
    out, raws = [], []
    for name in sorted(glob.glob(f"{path}/*")):
        raw = open(name, "rb").read()
        raws.append(raw)
        for part in raw.decode().replace("\r", "").split(">")[1:]:
            head, *body = part.split("\n")
            out.append((int(head.split()[0][4:]), "".join(body)))
    return out, raws


def test_groups_share_their_symbols(spark):
    rows = {r["key"]: r["length"] for r in records(spark).collect()}
    assert len(rows) == 6 * 5 and [rows[k] for k in range(5)] == [8400, 5400, 3200, 2000, 1000]
    assert {rows[k] for k in range(5, 15)} == {7} and rows[20] == 21504


@pytest.mark.parametrize("variant", planted.VARIANTS)
def test_variants_hold_what_is_answered(spark, tmp_path, variant):
    path = str(tmp_path / "out")
    width, end, backwards = planted.VARIANTS[variant]
    assert planted.written(records(spark), path, variant, file_symbols=40_000) > 1
    own, raws = plainly(path)
    made = {}
    for r in planted.content(records(spark)).orderBy("key", "start").collect():
        made[r["key"]] = made.get(r["key"], "") + r["bases"]
    assert dict(own) == made and len(own) == len(made)
    for raw in raws:
        lines = raw.decode().split(end)
        assert lines.pop() == "" and not any("\r" in x or "\n" in x or not x for x in lines)
        keys = [int(x.split()[0][5:]) for x in lines if x.startswith(">")]
        assert keys == sorted(keys, reverse=backwards) and all(PLANTED in x for x in lines if x.startswith(">"))
        for here, after in zip(lines, lines[1:] + [">"], strict=True):
            assert here.startswith(">") or after.startswith(">") or len(here) == width
    answer = planted.answers(planted.content(records(spark))).first()
    whole = "".join(made.values())
    assert answer["n_records"] == 30 and answer["planted"] == sum(t.upper().count(PLANTED) for t in made.values()) >= 60
    assert [answer[f"n_{c}"] for c in "acgt"] == [whole.upper().count(c) for c in "ACGT"] and answer["n_unknown"] == whole.upper().count("N") > 0
    assert (answer["n_ambiguous"], answer["n_invalid"]) == (whole.count("R"), whole.count("*")) and answer["n_invalid"] > 0
    assert "".join(t for _, t in sorted(own)).upper().count(PLANTED) > answer["planted"]  # over borders of records
    for size in (5003, 1 << 16) if variant == "crlf" else (50_021,):
        read = ranges.chunks(ranges.placed(spark, path, size).coalesce(8), planted.UNIT).selectExpr("concat_ws('#', file, rec) as key", "chunk", "start", "cast(bases as string) as bases")
        assert planted.answers(read).first() == answer


def test_files_stay_as_they_are_and_empty_tables_make_none(spark, tmp_path):
    path = str(tmp_path / "out")
    assert planted.written(records(spark, []), path) == 0 and plainly(path) == ([], [])
    assert planted.written(records(spark), path) == planted.written(records(spark), path) == 1
    assert len(glob.glob(f"{path}/*")) == 1 and not glob.glob(f"{path}/.*.tmp")
    assert planted.answers(planted.content(records(spark, []))).first()["n_records"] == 0
