import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds ``documents`` from (doc_id, text, lang, source) rows; ``extra`` adds columns whose names the operators use too."""

    def build(rows, extra=True):
        frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
        if extra:
            for name in ("size", "shard", "score", "copies", "sid", "n", "words", "key", "h", "root", "_bucket"):
                frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return build
