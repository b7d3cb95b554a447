import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of (id, text[, lang[, source]]) tuples."""

    def make(rows, parts=3):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A folder with a documents table of the given frame."""

    def write(df):
        folder = tmp_path_factory.mktemp("sf")
        df.write.parquet(str(folder / "documents.parquet"))
        return str(folder)

    return write


