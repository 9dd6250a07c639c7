"""Benchmark items of few words, and items in scripts without spaces."""

from test_text import frame

from panelworks.llm import decontam


def test_short_and_unspaced_items(spark):
    question = "日本で一番高い山の名前は何ですか"
    items = [(1, "Which year?"), (2, question), (3, "!!"), (4, None), (5, "東京")]
    docs = [(1, "so: which YEAR was it"), (2, "which one year"), (3, f"はい、{question}。富士山です"), (4, question.replace("一", "二")), (5, "京東 日本"), (6, "東京"), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contamination(frame(spark, docs), bench).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (4, 2, 1), (6, 5, 0)}
    assert {r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()} == {2, 5, 7}
