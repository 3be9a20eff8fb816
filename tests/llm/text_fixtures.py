import pytest

CLASH = {"id": "a", "name": "b", "n": 3, "size": 4, "pos": 5, "block": "c", "score": 0.5, "kept": True, "part": 1, "_id": 6}


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, source]) as a table with further columns whose names operators use themselves."""

    def make(rows, clash=True):
        wide = [(r[0], r[1], r[2] if len(r) > 2 else "s", *CLASH.values()) for r in rows]
        kinds = "id string, name string, n int, size int, pos int, block string, score double, kept boolean, part int, _id int"
        frame = spark.createDataFrame(wide, f"doc_id long, text string, source string, {kinds}")
        return frame if clash else frame.select("doc_id", "text", "source")

    return make

