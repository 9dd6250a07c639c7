"""Sources that read what they need: Stata files by row ranges, a store of comments by id, an instrument's flow."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.sources import external, readers


def stata(path, n, version):
    r = np.random.default_rng(1)
    df = pd.DataFrame({"b": r.integers(-100, 100, n).astype(np.int8), "i": r.integers(-30_000, 30_000, n).astype(np.int16), "l": r.integers(-(1 << 30), 1 << 30, n).astype(np.int32), "s": ["x" * (i % 7) for i in range(n)],
                       "f": r.normal(size=n).astype(np.float32), "d": np.where(r.random(n) < 0.2, np.nan, r.normal(size=n))})
    df.to_stata(path, write_index=False, version=version, data_label="labelled " * 5)
    return df


@pytest.mark.parametrize("version", [114, 117, 118, 119])
def test_stata_by_ranges(spark, tmp_path, version):
    p = str(tmp_path / "a.dta")
    df = stata(p, 1000, version)
    external.register(spark)
    read = lambda parts: spark.read.format("stata").options(path=p, columns="d,l,b,i,f", partitions=parts, chunk=70).load()
    got = read(5).collect()
    want = [tuple(None if np.isnan(x) else float(x) for x in row) for row in df[["d", "l", "b", "i", "f"]].to_numpy(np.float64)]
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(got) == key(want) and key(read(1).collect()) == key(want)
    assert read(5).rdd.getNumPartitions() == (5 if version > 114 else 1)


def test_stata_partitions_read_their_own_bytes(tmp_path):
    p = str(tmp_path / "a.dta")
    stata(p, 5000, 118)
    reader = external._StataReader(p, ["d"], 333, 7)
    parts = reader.partitions()
    rows = [sum(b.num_rows for b in reader.read(x)) for x in parts]
    assert sum(rows) == 5000 and max(rows) - min(rows) <= 1 and reader.taken <= os.path.getsize(p)
    with pytest.raises(ValueError, match="no columns of numbers"):
        external._StataReader(p, ["s"], 10, 2).partitions()
    stata(p, 0, 118)
    assert sum(b.num_rows for x in external._StataReader(p, ["d"], 10, 2).partitions() for b in external._StataReader(p, ["d"], 10, 2).read(x)) == 0


def test_store_reads_the_buckets_asked_for(spark, tmp_path):
    p = str(tmp_path / "store")
    comments = spark.range(4000).select(F.format_string("c%05d", "id").alias("id"), F.concat(F.lit("body "), "id").alias("body"))
    readers.write_store(comments, p, 16)
    ids = lambda n: spark.createDataFrame([(f"c{i * 37 % 4200:05d}",) for i in range(n)] + [(None,)], "id string")
    read = []
    for n in (1, 2, 400):
        got = readers.fetch_from_store(spark, p, ids(n), 16)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in readers.fetch_parents(comments, ids(n)).collect()} and got.columns == ["id", "body"]
        scan = spark.read.parquet(p).where(F.col("bucket").isin([r.b for r in ids(n).where("id IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).distinct().collect()]))
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in set(r.f for r in scan.select(F.input_file_name().alias("f")).distinct().collect())))
    assert read[0] < read[1] < read[2] and read[0] * 8 < read[2]
    assert readers.fetch_from_store(spark, p, ids(0), 16).count() == 0


def node(kind, name, *flow, **more):
    return {"Type": kind, "FlowID": name, **more, **({"Flow": list(flow)} if flow else {})}


def test_flow_of_an_instrument(spark, tmp_path):
    tree = node("Root", "FL_1", node("Block", "FL_2", ID="BL_a"), node("Branch", "FL_3", node("EmbeddedData", "FL_4"), node("EndSurvey", "FL_5")),
                node("BlockRandomizer", "FL_6", node("Standard", "FL_7", ID="BL_b"), node("Group", "FL_8", node("Branch", "FL_9", node("Standard", "FL_10", ID="BL_c"))), SubSet=1), node("Standard", "FL_11", ID="BL_d"))
    f = tmp_path / "i.qsf"
    f.write_text(json.dumps({"SurveyElements": [{"Element": "FL", "PrimaryAttribute": "x", "SecondaryAttribute": None, "Payload": tree}, {"Element": "SQ", "PrimaryAttribute": "Q", "SecondaryAttribute": None, "Payload": {}}]}))
    rows = readers.instrument_flow(spark, str(f)).collect()
    assert [(r.flow_id, list(r.path), r.kind, r.block_id, r.randomizer, r.shown, r.branch) for r in rows] == [
        ("FL_2", [0], "Block", "BL_a", None, None, None), ("FL_3", [1], "Branch", None, None, None, None), ("FL_4", [1, 0], "EmbeddedData", None, None, None, "FL_3"), ("FL_5", [1, 1], "EndSurvey", None, None, None, "FL_3"),
        ("FL_6", [2], "BlockRandomizer", None, None, None, None), ("FL_7", [2, 0], "Standard", "BL_b", "FL_6", 1, None), ("FL_8", [2, 1], "Group", None, "FL_6", 1, None), ("FL_9", [2, 1, 0], "Branch", None, "FL_6", 1, None),
        ("FL_10", [2, 1, 0, 0], "Standard", "BL_c", "FL_6", 1, "FL_9"), ("FL_11", [3], "Standard", "BL_d", None, None, None)]
    f.write_text(json.dumps({"SurveyElements": []}))
    assert readers.instrument_flow(spark, str(f)).count() == 0
