"""Quoted files split inside: the same records as one reader that goes from front to back."""

import csv
import random

import pytest

from shelfspark.sources.catalog_csv import read_catalog_csv, read_catalog_csv_split
from shelfspark.sources.quoted import quoted_lines, read_quoted_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(r):
    return "".join(r.choice(["a", "Б", '"', "\n", ",", " ", "x" * 40]) for _ in range(r.randrange(12)))


def test_records_equal_a_plain_reader(spark, tmp_path, small_splits):
    r = random.Random(6)
    want = {}
    for k in range(4):
        rows = [[str(i), cell(r), "y" * r.randrange(3000) if r.random() < 0.02 else cell(r)] for i in range(300 * k)]
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
        want[f"f{k}.csv"] = rows
    lines = quoted_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 20
    got = {}
    for row in sorted(read_quoted_records(spark, str(tmp_path)).collect(), key=lambda x: (x.file, x.record)):
        got.setdefault(row.file.rsplit("/", 1)[1], []).append(next(csv.reader([row.text])) if "\n" not in row.text else list(csv.reader(row.text.splitlines(keepends=True)))[0])
    assert got == {k: v for k, v in want.items() if v}


def test_catalog_rows_equal_those_of_whole_files(spark, tmp_path, small_splits):
    r = random.Random(7)
    for k, heading in enumerate((["Название", "Описание", "Цена"], ["name", "isbn", "annotation", "price"])):
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, delimiter=",;"[k], lineterminator="\n")
            out.writerow(heading)
            for i in range(400):
                row = {"Название": f"n{k}-{i}", "name": f"n{k}-{i}", "isbn": str(i), "Цена": f"{i},5", "price": f"{i}.5"}
                out.writerow([row.get(h, "t" + cell(r).strip() + "t") for h in heading])
    columns = ["name", "isbn", "annotation", "description", "price"]
    whole = read_catalog_csv(spark, str(tmp_path)).select(*columns).collect()
    split = read_catalog_csv_split(spark, str(tmp_path)).select(*columns).collect()
    assert len(whole) == 800 and sorted(whole) == sorted(split)


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_catalog_csv_split(spark, str(tmp_path)).isEmpty()
