import pytest


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("steps")))


@pytest.fixture
def docs(spark):
    """Rows of documents; extra columns clash with names the operators use inside."""

    def make(rows):
        wide = [(k, t, None, "s", 0, 1, 2, "x", None) for k, t in rows]
        return spark.createDataFrame(
            wide, "doc_id long, text string, lang string, source string, n_chars long, id long, key int, row string, label int"
        )

    return make
