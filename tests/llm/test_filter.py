"""The filter of rows misses none."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelworks.llm.common import FILTER_BITS, RowFilter, free_prefix


def test_no_row_is_missed(spark):
    r = random.Random(2)
    keys = [r.getrandbits(64) - (1 << 63) for _ in range(3000)] + [0, 1, -1, 32767, 32768, 32769, FILTER_BITS, FILTER_BITS - 1, -FILTER_BITS, (1 << 63) - 1, -(1 << 63)]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    passes = RowFilter(table, F.col("k"))
    assert passes(np.array(keys, np.int64)).all()
    others = np.array([r.getrandbits(64) - (1 << 63) for _ in range(20_000)], np.int64)
    assert passes(others).mean() < 0.001
    assert not RowFilter(table.limit(0), F.col("k"))(others).any()
    sent = spark.range(5).mapInArrow(lambda batches: (b.filter(pa.array(passes(b.column("id").to_numpy()))) for b in batches), "id long")
    assert sorted(r.id for r in sent.collect()) == [0, 1]


def test_names_that_clash_with_none():
    assert free_prefix([]) == "_" and free_prefix(["a", "b_"]) == "_" and free_prefix(["_x", "__y"]) == "___"
