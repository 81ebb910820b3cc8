"""JSON arrays cut at the ends of their records."""

import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from catalog import flow_queries
from lexmill.session import staging_root
from lexmill.sources import readers as R

BITS = ["}", "{", '"', "\\", "\n", ",", "[", "]", "é", "𝄞", '\\"', "plain words ", "\\}", '{"a": 1}', "\t"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records(n, seed=1):
    rng = random.Random(seed)
    return [{"i": k, "t": "".join(rng.choices(BITS, k=rng.randint(0, 50))), "x": {"y": [{"z": "}"}] * (k % 3), "e": {}}} for k in range(n)]


def test_arrays_objects_and_lines_are_read_by_several_tasks(spark, small_splits, tmp_path):
    rows = records(260)
    (tmp_path / "a.json").write_text(json.dumps(rows[:120], ensure_ascii=False, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(rows[120], ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps(rows[121:200]) + "\n")
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows[200:])))
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text("")
    found = R.json_records(spark, str(tmp_path)).collect()
    assert sorted((json.loads(r.record) for r in found), key=lambda x: x["i"]) == rows
    first = [json.loads(r.record)["i"] for r in sorted(found, key=lambda r: r.place) if r.file_path.endswith("a.json")]
    assert first == list(range(120)) and spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("text", ['{"a": 1', '[{"a": 1}, {"b": "x]', '[{"a": 1} junk {"a": 2}]', "nonsense", '[{"a": 1}]]x', '[{"a": 1}, {"a": {"b": 2}]'])
def test_files_that_are_not_whole_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a whole JSON record"):
        R.json_records(spark, str(tmp_path)).collect()


def test_an_array_of_articles_equals_its_lines(spark, small_splits, articles, tmp_path):
    texts = [r.j for r in articles.select(F.to_json(F.struct(*articles.columns)).alias("j")).collect()] * 5
    (tmp_path / "array").mkdir()
    (tmp_path / "lines").mkdir()
    (tmp_path / "array" / "x.json").write_text("[\n" + ",\n".join(texts) + "\n]\n", encoding="utf-8")
    (tmp_path / "lines" / "x.json").write_text("\n".join(texts), encoding="utf-8")
    one, other = R.read_articles(spark, str(tmp_path / "array")), R.read_articles(spark, str(tmp_path / "lines"), "jsonl")
    assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() == len(texts)
    (tmp_path / "array" / "y.json").write_text('[{"article_number": "no number"}]')
    with pytest.raises(Exception):
        R.read_articles(spark, str(tmp_path / "array")).collect()


def test_texts_are_not_stored_to_find_records(spark, small_splits, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"i": k, "t": "".join(random.Random(k).choices("abcdefghij {}", k=700))} for k in range(60)]
    (tmp_path / "in" / "a.json").write_text("[\n" + ",\n".join(map(json.dumps, rows)) + "]", encoding="utf-8-sig")
    root = pathlib.Path(staging_root(spark))
    before = set(root.iterdir())
    found = R.json_records(spark, str(tmp_path / "in")).collect()
    assert sorted((json.loads(r.record) for r in found), key=lambda x: x["i"]) == rows
    stored = set(root.iterdir()) - before
    assert stored and not any("value" in spark.read.parquet(str(f)).columns for f in stored)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_an_array_of_articles_is_one_file_and_goes_when_it_is_read(spark, tmp_path, monkeypatch, n):
    text = lambda k: None if k % 9 == 8 else f'line {k} "quoted" {{x}}\nArticle {k + 3} ]'
    rows = [(k - k % 2, text(k), "en", "web", 9) for k in range(n)]  # every id comes twice
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    read, seen = R.read_articles, []

    def noted(spark, path):
        files = list(pathlib.Path(path).glob("part-*"))
        whole = "".join(f.read_text() for f in files)
        seen.append((path, len([f for f in files if f.stat().st_size]), json.loads(whole) if whole else []))
        return read(spark, path)

    monkeypatch.setattr(R, "read_articles", noted)
    got = flow_queries.article_json_array(spark, str(tmp_path))
    path, files, array = seen[0]
    numbers = sorted(r.article_number for r in got.collect())
    assert files == min(n, 1) and sorted(x["article_number"] for x in array) == numbers == sorted(r[0] + 1 for r in rows)
    assert n == 0 or not pathlib.Path(path).exists()
