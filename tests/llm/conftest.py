import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns whose names the operators use inside."""
    def make(rows, extra=False):
        df = spark.createDataFrame(list(rows), DOCS)
        if extra:
            for name in ("key", "_id", "_key", "text_key", "score", "n_dropped", "h1", "tag", "blob", "row"):
                df = df.selectExpr("*", f"cast(doc_id as string) as {name}")
        return df

    return make
