import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """(rows of (doc_id, text[, source])) -> documents, with columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, DOCS)
        for c in ("size", "score", "key", "digest", "value", "target", "length", "rank", "id", "doc"):
            out = out.withColumn(c, F.lit("clash"))
        return out

    return make
