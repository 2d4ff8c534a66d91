import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang[, source]]) rows, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ()), *(None,) * (4 - max(len(r), 2)))[:4] for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        schema = DOCS + (", fp string, rid string, words string, size string, key string, row string, n int" if extra else "")
        tail = ("x", "y", None, "z", "k", "r", 1) if extra else ()
        return spark.createDataFrame([(*r, *tail) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """A folder with the given tables as Parquet."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)

