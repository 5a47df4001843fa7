import random

import pytest

from triagework.sources import tickets
from triagework.sources.csv_records import read_quoted_csv, records

CELLS = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "end\n", "\n\nthree\n", "", "é漢", 'x"\n"y', "a\r\nb", " pad "]


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\n\r') or cell != cell.strip() else cell


def written(path, rows, end="\n"):
    lines = [",".join(quoted(c) for c in row) for row in [("k", "a", "b"), *rows]]
    path.write_bytes((end.join(lines) + end).encode())


def rows_of(df):
    return sorted((r.k, r.a or "", r.b or "") for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_the_written_rows(spark, tmp_path, small_splits, end):
    rng = random.Random(3)
    rows = [(str(i), rng.choice(CELLS), rng.choice(CELLS) * rng.choice([1, 1, 9])) for i in range(700)]
    rows[350] = ("350", "long\n" * 1_500, "tail")
    written(tmp_path / "t.csv", rows, end)
    found = records(spark, str(tmp_path / "t.csv"))
    assert found.select("block").distinct().count() > 10
    assert rows_of(read_quoted_csv(spark, str(tmp_path / "t.csv"))) == sorted(rows)


def test_equals_the_one_split_read(spark, tmp_path, small_splits):
    folder = tmp_path / "folder"
    folder.mkdir()
    rng = random.Random(4)
    for n in range(3):
        written(folder / f"{n}.csv", [(f"{n}-{i}", rng.choice(CELLS), rng.choice(CELLS)) for i in range(120)])
    one = tickets.read_ticket_csv(spark, str(folder), line_breaks=True, parallel=False)
    many = tickets.read_ticket_csv(spark, str(folder), line_breaks=True)
    assert many.columns == one.columns == ["k", "a", "b"]
    assert rows_of(many) == rows_of(one)


def test_open_quote_at_the_end_and_empty_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('k,a,b\n1,x,"never\nclosed')
    got = read_quoted_csv(spark, str(tmp_path / "open.csv")).collect()
    assert len(got) == 1 and got[0].k == "1"
    (tmp_path / "none.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "header.csv").write_text('k,a,"b\nc"\n\n')
    only = read_quoted_csv(spark, str(tmp_path / "header.csv"))
    assert only.columns == ["k", "a", "b\nc"] and only.count() == 0
