import pytest

from lectern.llm.registry import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size string, of string, score string, tie string, group string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from ``(doc_id, text[, source])``, with nulls and names the operators use too."""
    prepare(spark)

    def made(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made
