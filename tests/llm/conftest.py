import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators also use."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, media string, shard int, node long, score double, ids string"
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), None, 1, None, 0.5, "x") for i, t in rows], schema)

    return make


#: Nulls in every column, empty and long texts, ties and repeated rows.
AWKWARD = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "no id"), (None, None), (4, "ß😀 ＡＢ\x00\t\r\n"), (5, "long words " * 30_000), (6, "plain words here")]
