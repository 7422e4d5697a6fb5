from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make a table of documents from (doc_id, text) rows, with the other columns and one that clashes."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        from pyspark.sql import functions as F

        return df.withColumn("node", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("size", F.lit(2)) if extra else df

    return make
