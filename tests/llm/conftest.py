import pytest

DOCS = "extra_id string, doc_id bigint, text string, lang string, source string, n_chars bigint, word string"


@pytest.fixture
def docs(spark):
    """Build documents with extra columns whose names clash with the operators' own."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [("e", i, t, None, None, None, "w") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return build


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "", str(x)) for x in r))
