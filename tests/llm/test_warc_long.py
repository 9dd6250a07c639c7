"""Archives with long headers, and archives that are cut short."""

import pytest

from panelworks.llm import warc


@pytest.mark.parametrize("at", [0, 2])
def test_url_of_over_64_kb(spark, tmp_path, at):
    pages = [(i, "http://a/" + ("x y" * 30_000 if i == at else ""), f"text {i}", "e") for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string").coalesce(1)
    p = str(tmp_path / "w")
    warc.write_warc(df.orderBy("page_id"), p, per_file=100)
    got = {r.record_id: r.target for r in warc.read_warc(spark, p).collect()}
    assert got == {f"<urn:page:{i}>": u.replace(" ", "%20") for i, u, _, _ in pages}


@pytest.mark.parametrize("change", [lambda b: b[:-3], lambda b: b + b"more", lambda b: b"x" + b, lambda b: b.replace(b"Length", b"Size")])
def test_a_broken_chain_is_an_error(spark, tmp_path, change):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3)
    assert warc.read_warc(spark, str(tmp_path)).count() == 3
    (tmp_path / "a.warc").write_bytes(change(record * 3))
    with pytest.raises(Exception, match="no record in|do not lead to its end"):
        warc.read_warc(spark, str(tmp_path)).collect()
