"""The table maker that the tests of this folder share."""

import pytest


@pytest.fixture
def docs(spark):
    """Make a table of documents from (doc_id, text[, lang[, source]]) rows."""

    def make(rows, extra=False):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("id", "word", "score", "part", "tokens", "size", "kind", "count", "hash", "item_id", "rule", "start", "_doc", "_text", "key", "text_hash", "group_id", "kept", "bits", "stays"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
