"""Readers: text tables with every column a string and blanks kept, JSON lines, instruments and configurations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab


def _path_lines(spark: SparkSession, path: str) -> str:
    """The first line of a text file, through Spark's file systems."""
    first = spark.read.text(path).limit(1).collect()
    return first[0].value if first else ""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """A delimited table, each column a string, blank cells kept as "".  Quotes are doubled inside quotes; cells may
    hold line breaks; compressed files are read by their suffix.  A file whose cells may hold line breaks is one task; with
    multi_line=False it is split."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("inferSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.na.fill("")


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are left out."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"))
    return parsed.select("r.*")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: JSON lines (a schema is needed), Parquet, or CSV."""
    bare = path.removesuffix(".gz")
    if bare.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    return spark.read.parquet(path) if bare.endswith(".parquet") else read_csv(spark, path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep=";")


def read_targets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``variable, category, share`` of those files that are there."""
    out = spark.createDataFrame([], "variable string, category string, share double")
    for p in paths:
        if exists(spark, p):
            t = read_csv(spark, p)
            out = out.unionByName(t.select("variable", "category", F.col(t.columns[-1]).try_cast("double").alias("share")))
    return out


def last_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def first_authors(history: DataFrame, n: int, seq: str = "seq", author: str = "author") -> DataFrame:
    """Rows of the first n authors by first appearance."""
    chosen = history.groupBy(author).agg(F.min(seq).alias("at")).orderBy("at", author).limit(n).select(author)
    return history.join(chosen, author, "left_semi")


def strip_export_header(df: DataFrame, seq: str = "seq", mark: str = "ImportId") -> DataFrame:
    """A raw survey export without the extra header rows: of the first two rows all up to the last with the mark go."""
    text = F.concat_ws("\u0001", *[F.col(c) for c in df.columns if c != seq])
    head = df.orderBy(seq).limit(2).select(seq, F.contains(text, F.lit(mark)).alias("hit"))
    last = head.agg(F.max(F.when(F.col("hit"), F.col(seq)))).first()[0]
    return df if last is None else df.where(F.col(seq) > last)


def only_csv(spark: SparkSession, folder: str) -> str:
    """The one CSV file of a folder."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.csv")
    found = [str(s.getPath()) for s in (p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} CSV files in {folder}; one is wanted")
    return found[0]


def read_json_document(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0].value)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, also one whose name begins with a dot, which Spark's readers pass over."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """The small text files of a folder (templates, stimuli) by name without suffix."""
    rows = spark.read.text(folder.rstrip("/") + "/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), "value").collect()
    return {r.name: r.value.strip() for r in rows}


def active_candidates(posts: DataFrame, communities: DataFrame, at_least: int = 5, recent: int = 30, since: int = 0) -> DataFrame:
    """Authors with enough posts in the communities and enough recent posts anywhere."""
    known = communities.select(F.lower("subreddit").alias("subreddit")).distinct().withColumn("known", F.lit(True))
    joined = posts.withColumn("subreddit", F.lower("subreddit")).join(known, "subreddit", "left")
    return joined.groupBy("author").agg(F.count_if("known").alias("in_states"),
        F.count_if(F.col("created_utc").cast("double") >= since).alias("recent")).where((F.col("in_states") >= at_least) & (F.col("recent") >= recent))


def fetch_parents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a store of comments whose id is asked for."""
    return store.join(ids.select(F.col("id")).distinct(), "id", "left_semi")


#: Buckets of a store of comments.
STORE_BUCKETS = 256


def write_store(comments: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> None:
    """A store of comments by id: a folder for each bucket of ids, rows in the order of ids, so that statistics tell where an id can be."""
    placed = comments.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(path)


def fetch_from_store(spark: SparkSession, path: str, ids: DataFrame, buckets: int = STORE_BUCKETS) -> DataFrame:
    """Rows of a store whose id is asked for.  Only the buckets of those ids are listed and read, and in them what lies between the
    least and the greatest of the ids."""
    wanted = ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    told = wanted.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.min("id").alias("least"), F.max("id").alias("most")).collect()  # as many rows as buckets
    store = spark.read.parquet(path)
    if not told:
        return store.drop("bucket").limit(0)
    least, most = min(r.least for r in told), max(r.most for r in told)
    part = store.where(F.col("bucket").isin([r.bucket for r in told]) & F.col("id").between(least, most))
    return fetch_parents(part.drop("bucket"), wanted)


def synthetic_agents(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Agents with random levels; the same for a seed, however the rows are dealt."""
    def pick(name: str, levels: list[str]):
        number = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(len(levels)))
        return F.get(F.array(*[F.lit(x) for x in levels]), number.cast("int")).alias(name)

    states = sorted(s for ss in vocab.STATE_CASES.values() for s in ss)
    d = spark.range(n).select(
        F.format_string("agent_%04d", F.col("id") + 1).alias("profile_id"), F.format_string("user_%04d", F.col("id") + 1).alias("author"),
        *[pick(m, levels) for m, levels in vocab.MODERATORS.items()], pick("assigned_state", states),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("year"), F.col("id")), F.lit(12)).alias("_y"))
    top = F.create_map(*[F.lit(x) for kv in {"18-29": 2026 - 29, "30-44": 2026 - 44, "45-59": 2026 - 59, "60+": 2026 - 75}.items() for x in kv])
    return d.withColumn("year_birth", (top[F.col("age_band")] + F.col("_y")).cast("int")).drop("_y")


def synthetic_posts(spark: SparkSession, agents: DataFrame, per_author: int = 8, seed: int = 7) -> DataFrame:
    words = F.array(*[F.lit(w) for w in "weather garden policy science river market bus school winter storm book radio".split()])
    number = lambda *k: F.xxhash64(F.lit(seed), F.col("author"), F.col("i"), *[F.lit(x) for x in k])
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda j: F.get(words, F.pmod(F.xxhash64(F.lit(seed), "author", "i", j), F.lit(12)).cast("int"))), " ")
    return agents.select("author", F.explode(F.sequence(F.lit(1), F.lit(per_author))).alias("i")).select(
        "author", F.when(number("t") % 2 == 0, "submission").otherwise("comment").alias("type"), F.get(words, F.pmod(number("s"), F.lit(12)).cast("int")).alias("subreddit"),
        (F.lit(1_700_000_000) + F.pmod(number("c"), F.lit(20_000_000))).cast("string").alias("created_utc"),
            F.when(number("t") % 2 == 0, F.concat(F.lit("About "), F.left(body, F.lit(20)))).alias("title"), body.alias("body"), F.lit("1").alias("score"))


_NODE = "struct<Type:string,FlowID:string,ID:string,Description:string,SubSet:int,EvenPresentation:boolean,Flow:array<string>>"


def instrument_flow(spark: SparkSession, path: str, deepest: int = 64) -> DataFrame:
    """The flow of a survey instrument as rows, in the order in which it is walked: ``path`` (numbers from the root down), ``position``
    among its siblings, ``depth, kind, flow_id, block_id, description``, ``randomizer`` (the flow id of the innermost randomizer it is
    in) with ``shown`` (how many of that one's parts are shown) and ``branch`` (that of the innermost branch).

    A node's children are JSON texts inside it; each level of them is read out of the level above."""
    doc = instrument_elements(spark, path).where("element = 'FL'")
    none = F.lit(None).cast("string")
    level = doc.select(F.from_json("payload", _NODE).alias("n"), F.array().cast("array<int>").alias("path"), none.alias("randomizer"), F.lit(None).cast("int").alias("shown"), none.alias("branch"))
    out = None
    for _ in range(deepest):
        children = level.select("path", "randomizer", "shown", "branch", F.col("n.Type").alias("above"), F.col("n.FlowID").alias("above_id"),
            F.col("n.SubSet").alias("above_shown"), F.posexplode("n.Flow").alias("position", "node"))
        random, inner = F.col("above").endswith("Randomizer"), F.col("above") == "Branch"
        level = children.select(
            F.from_json("node", _NODE).alias("n"), F.concat("path", F.array("position")).alias("path"), "position",
                F.when(random, F.col("above_id")).otherwise(F.col("randomizer")).alias("randomizer"),
            F.when(random, F.col("above_shown")).otherwise(F.col("shown")).alias("shown"), F.when(inner, F.col("above_id")).otherwise(F.col("branch")).alias("branch"))
        # An instrument is one document, and a level of it a few hundred rows.
        level = spark.createDataFrame(level.collect(), level.schema)
        if level.isEmpty():
            break
        part = level.select("path", "position", F.size("path").alias("depth"), F.col("n.Type").alias("kind"), F.col("n.FlowID").alias("flow_id"),
            F.col("n.ID").alias("block_id"), F.col("n.Description").alias("description"), "randomizer", "shown", "branch")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path array<int>, position int, depth int, kind string, flow_id string, block_id string, description string, randomizer string, shown int, branch string")
    return out.orderBy("path")


def instrument_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a survey instrument (one JSON document): ``element, primary, secondary, payload`` with the payload as JSON."""
    schema = "SurveyElements array<struct<Element:string,PrimaryAttribute:string,SecondaryAttribute:string,Payload:string>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return doc.select(F.explode("d.SurveyElements").alias("e")).select(F.col("e.Element").alias("element"), F.col("e.PrimaryAttribute").alias("primary"),
        F.col("e.SecondaryAttribute").alias("secondary"), F.col("e.Payload").alias("payload"))
