import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_df(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) or whole rows."""

    def make(rows):
        full = []
        for r in rows:
            r = tuple(r)
            if len(r) == 5:
                full.append(r)
                continue
            text, source = r[1], (r[2] if len(r) > 2 else "s")
            full.append((r[0], text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def rows_of():
    """Sorted row tuples of some columns."""

    def get(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    return get
