import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns filled in."""

    def make(pairs, langs=None, sources=None):
        rows = [
            (i, t, langs[k] if langs else "en", sources[k] if sources else "src0", None if t is None else len(t))
            for k, (i, t) in enumerate(pairs)
        ]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return make


@pytest.fixture
def clashing():
    """``df`` with more columns whose names the operators use themselves or that differ in case."""

    def add(df):
        names = ["DOC_ID", "Text", "fp", "doc_key", "component", "follower", "_id", "_text", "_ranges", "words", "piece", "p"]
        return df.select("*", *[df[df.columns[0]].cast("string") for _ in names]).toDF(*df.columns, *names)

    return add
