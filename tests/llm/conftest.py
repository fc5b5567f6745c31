import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """Checkpoints of these tests; only set where the session names no folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with further columns whose names clash with the operators' own."""

    def make(rows, n_files=3):
        schema = "doc_id long, text string, lang string, source string, n_chars int, scan string, blob string, found string, counts_ int, node int, n int, tables int"
        full = [(i, t, "en", "src0", len(t or ""), "s", "b", "f", 1, 2, 3, 4) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(n_files)

    return make
