"""One row of each component, also with null and repeated ids."""

from test_text import frame

from panelworks.llm import simhash

WORDS = [f"w{i}" for i in range(400)]


def copy(start, *more):
    return " ".join([*WORDS[start : start + 150], *more])


def test_null_and_repeated_ids_by_row(spark):
    docs = [(None, copy(0)), (None, copy(0).upper()), (None, copy(0)), (None, copy(200)), (5, copy(200).upper()), (5, "alone"), (5, copy(100)), (6, copy(100).upper()), (7, None)]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(frame(spark, docs)).collect()]
    assert sorted((x for x in got if x[0] is not None), key=repr) == sorted([(5, copy(200).upper()), (5, "alone"), (5, copy(100)), (7, None)], key=repr)
    assert [t.lower() for d, t in got if d is None] == [copy(0)]


def test_columns_that_clash_are_kept(spark):
    names = ["doc_id", "text", "_row", "_none", "__id", "hash", "root", "node"]
    df = spark.createDataFrame([(i, copy(100 * (i // 2)), *"abcdef") for i in range(6)], names)
    got = simhash.keep_one(df)
    assert got.columns == names and sorted(r.doc_id for r in got.collect()) == [0, 2, 4] and all(tuple(r)[2:] == tuple("abcdef") for r in got.collect())
