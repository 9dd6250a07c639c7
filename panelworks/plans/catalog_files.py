"""Queries over readers and writers: tables go out to files and come back, and the SQL states what must be there."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, history
from ..sources import readers, sinks
from .registry import query, scratch, table


def _part(path: str) -> str:
    return path + "/*"


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, sha256(coalesce(text, '')) AS text_sha FROM documents")
def csv_quoted_cells(spark, sf_dir):
    """Cells with quotes, delimiters and line breaks through a CSV file."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return readers.read_csv(spark, path).select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_compressed(spark, sf_dir):
    path = scratch(spark, "csv-gz")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_csv(spark, path + "/*.csv.gz")


@query("SELECT n_name AS state, 'r/' || n_name AS subreddit, CAST(n_regionkey AS VARCHAR) AS members FROM nation")
def reference_table(spark, sf_dir):
    path = scratch(spark, "states")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"), F.concat(F.lit("r/"), "n_name").alias("subreddit"), F.col("n_regionkey").alias("members"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_states(spark, path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_typed(spark, sf_dir):
    path = scratch(spark, "typed")
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_typed_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("""
SELECT CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS post_type, conv_id || '_' || turn AS id, lower(role) AS author, sha256(coalesce(text, '')) AS body_sha,
  CASE WHEN turn = 0 THEN 'T' || conv_id ELSE '' END AS title, CASE WHEN turn > 0 THEN 't3_' || conv_id || '_0' ELSE '' END AS parent_id FROM conversations
""")
def history_of_exports(spark, sf_dir):
    """Two exports of posts, under other column names and partly the same, and one of comments, as one history."""
    t = table(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    posts = t.where("turn = 0").select(F.concat(F.lit(" "), F.upper("role")).alias("author_key"), key.alias("Post_ID"), F.col("text").alias("selftext"),
        F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("TITLE"))
    comments = t.where("turn > 0").select(F.col("role").alias("author"), key.alias("id"), F.col("text").alias("body"),
        F.concat(F.lit("t3_"), F.col("conv_id").cast("string"), F.lit("_0")).alias("parent_id"))
    paths = []
    for name, df in (("a", posts), ("b", posts.where("TITLE LIKE '%1'").withColumn("selftext", F.lit("later copy"))), ("c", comments)):
        paths.append(scratch(spark, f"export-{name}"))
        sinks.write_csv(df, paths[-1])
    a, b, c = (readers.read_csv(spark, p) for p in paths)
    made = history.build_history([a, b], [c])
    return made.select("post_type", "id", "author", F.sha2("body", 256).alias("body_sha"), "title", "parent_id")


@query("SELECT event_id, user_id, event_type FROM events")
def json_lines(spark, sf_dir):
    """JSON lines with blank lines between."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(path)
    return readers.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SELECT CAST(user_id AS VARCHAR) AS author, lower(trim(event_type)) AS subreddit, count(*) AS total FROM events WHERE event_type IS NOT NULL AND trim(event_type) <> '' GROUP BY 1, 2")
def activity_file(spark, sf_dir):
    """The nested activity of authors through a file and flat again."""
    path = scratch(spark, "activity")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("subreddit"))
    sinks.write_jsonl(activity.activity_map(activity.activity_counts(e)), path)
    return activity.explode_map(readers.read_jsonl(spark, path, "author string, subreddit_activity map<string,struct<total:bigint>>"))


@query("SELECT f.format, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer, (VALUES ('csv'), ('jsonl'), ('parquet')) f(format)")
def formats_by_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    base, out = scratch(spark, "suffix"), None
    sinks.write_csv(rows, f"{base}.csv")
    sinks.write_jsonl(rows, f"{base}.jsonl")
    rows.write.parquet(f"{base}.parquet")
    for f in ("csv", "jsonl", "parquet"):
        part = readers.read_table(spark, f"{base}.{f}", "id string, segment string").select(F.lit(f).alias("format"), "id", "segment")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'segment' AS variable, c_mktsegment AS category, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM customer GROUP BY 2")
def targets_that_are_there(spark, sf_dir):
    """Target files of which one does not exist."""
    path = scratch(spark, "targets")
    c = table(spark, sf_dir, "customer")
    shares = c.groupBy(F.lit("segment").alias("variable"), F.col("c_mktsegment").alias("category")).agg((F.count(F.lit(1)) / c.count()).alias("weighted_share"))
    sinks.write_csv(shares, path)
    return readers.read_targets(spark, [path, path + "-missing"]).withColumn("share", F.round("share", 9))


@query("SELECT r_name AS name, r_regionkey AS n FROM region")
def json_document(spark, sf_dir):
    path = scratch(spark, "document")
    doc = {r.r_name: {"n": r.r_regionkey, "é": [1]} for r in table(spark, sf_dir, "region").collect()}
    spark.createDataFrame([(sinks.dump(doc).rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    got = readers.read_json_document(spark, path)
    return spark.createDataFrame([(k, v["n"]) for k, v in got.items()], "name string, n int")


@query("SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS answer FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders)")
def export_without_headers(spark, sf_dir):
    """A raw export whose first row repeats what the columns are."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("answer"))
    first = o.agg(F.min("seq")).first()[0]
    return readers.strip_export_header(o.withColumn("answer", F.when(F.col("seq") == first, F.lit('{"ImportId":"QID1"}')).otherwise(F.col("answer"))))


@query("SELECT count(*) AS rows FROM supplier")
def the_only_csv(spark, sf_dir):
    path = scratch(spark, "only")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, one_file=True)
    return readers.read_csv(spark, readers.only_csv(spark, path)).agg(F.count(F.lit(1)).alias("rows"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS author, count(*) FILTER (WHERE event_type = 'click') AS in_states, count(*) FILTER (WHERE value >= 10) AS recent
FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'click') >= 1 AND count(*) FILTER (WHERE value >= 10) >= 2
""")
def active_candidates(spark, sf_dir):
    posts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("author"), F.upper("event_type").alias("subreddit"), F.col("value").alias("created_utc"))
    return readers.active_candidates(posts, spark.createDataFrame([("Click",)], "subreddit string"), 1, 2, 10)


@query("SELECT o_orderkey AS id, o_orderstatus AS body FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)")
def parents_by_id(spark, sf_dir):
    store = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("body"))
    return readers.fetch_parents(store, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT n_name AS name, n_name || ' text' AS text FROM nation")
def text_files(spark, sf_dir):
    """Small text files of a folder, each by its name."""
    base, out = scratch(spark, "texts"), []
    for r in table(spark, sf_dir, "region").collect():
        # One folder for each region, as templates are kept; the writer names the files, a column tells what is in them.
        names = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == r.r_regionkey).select(F.concat("n_name", F.lit(" text\n")).alias("value"))
        names.repartition(5, "value").write.text(f"{base}/{r.r_regionkey}")
        out += [(line.removesuffix(" text").strip(), line.strip()) for text in readers.read_texts(spark, f"{base}/{r.r_regionkey}").values() for line in text.splitlines() if line.strip()]
    return spark.createDataFrame(out, "name string, text string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '' AS absent, coalesce(c_mktsegment, '') AS c_mktsegment FROM customer")
def chosen_columns(spark, sf_dir):
    """Only the columns asked for, blanks for one that isn't there."""
    path = scratch(spark, "columns")
    sinks.write_csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "absent", "c_mktsegment"])
    return readers.read_csv(spark, path)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def appended_log(spark, sf_dir):
    """A log to which two batches are added."""
    path = scratch(spark, "log")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    for status in (F.col("status") == "F", F.col("status") != "F"):
        sinks.append_log(o.where(status), path)
    return readers.read_jsonl(spark, path, "id bigint, status string")


@query("SELECT true AS refused, count(*) AS rows FROM supplier")
def overwrite_refused(spark, sf_dir):
    path, refused = scratch(spark, "once"), False
    s = table(spark, sf_dir, "supplier")
    sinks.write_csv(s, path)
    try:
        sinks.write_csv(s.limit(0), path)
    except Exception as e:
        refused = "ALREADY_EXISTS" in str(e)
    return readers.read_csv(spark, path).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"))


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10)) AS sha256, CAST(sum(length(r_name) + 1) AS BIGINT) AS bytes FROM region")
def file_fingerprints(spark, sf_dir):
    path = scratch(spark, "hashed")
    table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    return sinks.fingerprints(spark, path + "/part-*").select("sha256", "bytes")


@query("SELECT r_name AS file, CASE WHEN r_regionkey < 3 THEN 'new' ELSE 'old' END AS version FROM region")
def manifest_upsert(spark, sf_dir):
    """Fresh entries take the place of those for the same file; an example goes."""
    names = [(r.r_name, r.r_regionkey) for r in table(spark, sf_dir, "region").collect()]
    old = [{"file": n, "version": "old"} for n, _ in names] + [{"file": "example_a.csv", "version": "old"}]
    made = json.loads(sinks.dump(sinks.upsert_manifest(old, [{"file": n, "version": "new"} for n, k in names if k < 3])))
    return spark.createDataFrame([(e["file"], e["version"]) for e in made], "file string, version string")


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def normalized_keys(spark, sf_dir):
    """Keys in their normal form, whatever white space is around them."""
    odd = F.concat(F.lit(" \t "), "c_mktsegment", F.lit(" \n"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.key(odd).alias("segment"))
