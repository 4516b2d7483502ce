"""CSV with quoted line breaks read in many splits, against Python's csv."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from quarry.session import materialize
from quarry.sources import quoted_csv
from quarry.sources.quoted_csv import csv_records, read_quoted_csv

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType()),
                       T.StructField("tail", T.StringType())])
CONF = "spark.sql.files.maxPartitionBytes"
SPLITS = []


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Cut the text in splits of n bytes, but not what is written from it."""
    def use(n):
        def cut(df, tag):
            old = spark.conf.get(CONF)
            spark.conf.set(CONF, str(n))
            try:
                SPLITS.append(df.rdd.getNumPartitions())
                return materialize(df, tag)
            finally:
                spark.conf.set(CONF, old)
        monkeypatch.setattr(quoted_csv, "materialize", cut)
    return use


def write(folder, name, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    (folder / name).write_bytes(out.getvalue().encode())
    return out.getvalue()


def parsed(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text, newline="")) if r][1:]


def noted_rows(seed, n):
    rng = random.Random(seed)
    bits = ["lake", "a,b", 'say "hi"', "two\nlines", "\n\n", '"', '""', ",\n,", "é\r\nü", "x" * 90, '"\n"', "plain"]
    return [["id", "note", "tail"]] + [
        [str(i), "z" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 5))), rng.choice(["t", 'u"u', "v\n"])] for i in range(n)]


@pytest.mark.parametrize("size", [150, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_python_csv(spark, tmp_path, small_splits, size, end):
    small_splits(size)
    texts = [write(tmp_path, f"{k}.csv", noted_rows(k, 25), end) for k in range(2)]
    want = sorted((int(a), b, c) for t in texts for a, b, c in parsed(t))
    got = sorted(tuple(r) for r in read_quoted_csv(spark, str(tmp_path), SCHEMA).collect())
    assert got == want


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    small_splits(200)
    write(tmp_path, "one.csv", noted_rows(5, 80))
    assert read_quoted_csv(spark, str(tmp_path), SCHEMA).count() == 80
    assert SPLITS[-1] > 5


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_record_longer_than_many_splits_and_unclosed_quote(spark, tmp_path, small_splits, size):
    small_splits(size)
    (tmp_path / "a.csv").write_text('id,note,tail\n1,"' + "line, of text\n" * 40 + '",t\n\n2,b"c,d"\n3,"open\n4,x,y\n')
    got = {r.id: (r.note, r.tail) for r in read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()}
    assert got[1] == ("line, of text\n" * 40, "t")
    assert got[2] == ('b"c', 'd"')  # quotes inside an unquoted cell are text
    assert set(got) == {1, 2, 3}    # the open quote of row 3 holds the rest
    assert sorted(r.record for r in csv_records(spark, str(tmp_path)).where("header").collect()) == ["id,note,tail"]


def test_headers_are_checked_and_empty_files_have_no_rows(spark, tmp_path, small_splits):
    small_splits(16)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,note,tail\r\n")
    assert read_quoted_csv(spark, str(tmp_path), SCHEMA).collect() == []
    (tmp_path / "short.csv").write_text("\nid,note,tail\n7\n8,,\n")
    assert sorted(tuple(r) for r in read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()) == [(7, None, None), (8, None, None)]
    for bad in ("id,note\n1,2\n", "id,note,tail,more\n1,2,3,4\n", "id,tail,note\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            read_quoted_csv(spark, str(tmp_path), SCHEMA)
