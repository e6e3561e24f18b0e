"""Quoted CSV by blocks, held against Python's parser of the whole file."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from clausewright.sources.csv_blocks import read_quoted_csv, record_ends, records_of
from clausewright.sources.files import read_training_csv


def some_file(choose, n, ends):
    held = io.StringIO(newline="")
    out = csv.writer(held, lineterminator=ends)
    out.writerow(["text", "label, quoted", "n"])
    rows = []
    for i in range(n):
        text = "".join(choose.choice(['a', '"', ",", "\n", "\r\n", "é日", " ", "word"]) for _ in range(choose.randint(0, 30)))
        rows.append([text, choose.choice(["x", '"', ""]), str(i)])
        out.writerow(rows[-1])
    return held.getvalue().encode(), rows


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_every_record_is_read_once_whatever_the_blocks(ends):
    choose = random.Random(9)
    for size in (1, 2, 3, 7, 20, 64, 1000, 10**6):
        data, rows = some_file(choose, 25, ends)
        found, quotes = b"", 0
        for start in range(0, len(data), size):
            found += records_of(io.BytesIO(data), start, min(start + size, len(data)), quotes)
            quotes += data[start : start + size].count(b'"')
        assert found == data
        assert len(record_ends(data, 0)) == 26
    assert records_of(io.BytesIO(b'a\nb"'), 0, 4, 0) == b'a\nb"'


def test_one_file_by_several_tasks(spark, tmp_path):
    data, rows = some_file(random.Random(1), 2000, "\n")
    (tmp_path / "one.csv").write_bytes(b"\xef\xbb\xbf" + data)
    frame = read_quoted_csv(spark, str(tmp_path / "one.csv"), 3000)
    assert frame.columns == ["text", "label, quoted", "n"]
    assert sorted((list(r) for r in frame.collect()), key=lambda r: int(r[2])) == rows
    assert frame.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_folders_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3"\n\n4\n5,6,7')
    (tmp_path / "b.csv").write_text("x,y\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    got = read_quoted_csv(spark, f"file://{tmp_path}", 5).collect()
    assert sorted(map(tuple, got)) == [("1", "2\n3"), ("4", None), ("5", "6")]
    (tmp_path / "d.csv").write_text("x,z\n")
    with pytest.raises(ValueError):
        read_quoted_csv(spark, str(tmp_path))


def test_training_sets_come_by_blocks(spark, tmp_path):
    (tmp_path / "train.csv").write_text('label,text\nliability," The supplier\nis ""liable"" "\nnone such,text\ntermination,\n')
    assert [tuple(r) for r in read_training_csv(spark, str(tmp_path / "train.csv")).select("text", "label").collect()] == [('The supplier\nis "liable"', "liability")]


def test_documents_are_written_as_files_of_some_rows(spark, monkeypatch):
    """a task holds a thousand rows as a file, not a batch of ten thousand."""
    from clausewright.plans import queries

    seen = []
    monkeypatch.setattr(queries, "write_files", lambda files, folder: seen.append(files))
    monkeypatch.setattr(queries, "read_quoted_csv", lambda spark, *_: spark.createDataFrame([("1", "a", "b")], "doc_id string, text string, source string"))
    queries.csv_records(spark, "/root/testdata/sf0.1")
    names = [r["path"] for r in seen[0].select("path").collect()]
    assert len(names) == len(set(names)) >= 10
