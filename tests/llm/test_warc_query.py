"""The registered query goes by the chain: ranges, candidates and jumping decide the records."""

import hashlib

from panelworks.llm import queries, warc

FALSE = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_false_starts_at_borders_of_ranges(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://h/{i}", FALSE * (1 + i % 4) if i % 2 else f"page {i} " * 40) for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    entered = []
    plain = warc._entries

    def entries(found):
        made = plain(found)
        entered.extend(made.collect())
        return made

    monkeypatch.setattr(warc, "_entries", entries)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sets = [("spark.sql.files.maxPartitionBytes", "600"), ("spark.sql.files.openCostInBytes", "0")]
    old = {k: spark.conf.get(k) for k, _ in sets}
    for k, v in sets:
        spark.conf.set(k, v)
    try:
        got = queries.op9_warc(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert before == old["spark.sql.files.maxPartitionBytes"] and len(entered) > 20
    first = {}
    for i, _, html in pages:
        first.setdefault(html, i)
    want = [(i, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "response" if first[html] == i else "revisit", None if first[html] == i else first[html]) for i, _, html in pages]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
