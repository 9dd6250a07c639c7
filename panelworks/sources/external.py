"""Sources that Spark has no reader for, as Python data sources: Stata files and a census JSON service."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .recordlog import opened


class StataSource(DataSource):
    """``format("stata")``: options ``path`` and ``columns`` (comma separated).  Raw codes, each as a double or string."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return ", ".join(f"`{c}` double" for c in self._columns())

    def reader(self, schema):
        return _StataReader(self.options["path"], self._columns(), int(self.options.get("chunk", "50000")), int(self.options.get("partitions", "1")))


class _Rows(InputPartition):
    """Rows from first up to last, where they lie in the file, and how a row is laid out."""

    def __init__(self, first: int, last: int, data: int, row: np.dtype):
        super().__init__((first, last))
        self.data, self.row = data, row


#: Numeric types of the tagged file formats as numpy has them, and from which number on a value of each is missing.
_TYPES = {65526: ("f8", 2.0**1023), 65527: ("f4", 2.0**127), 65528: ("i4", 2147483621), 65529: ("i2", 32741), 65530: ("i1", 101)}
#: Bytes of a variable's name, and the numpy types of the counts of variables and rows, by release.
_LAYOUT = {117: (33, "u2", "u4"), 118: (129, "u2", "u8"), 119: (129, "u4", "u8")}


class StataHeader:
    """What the head of a tagged file (releases 117 to 119) says: rows, where they begin, how wide they are, and where columns lie in them."""

    def __init__(self, file):
        head = file.read(512)
        if not head.startswith(b"<stata_dta>"):
            raise ValueError("an older release; no offsets to go by")
        tag = lambda name: head.index(b"<" + name + b">") + len(name) + 2
        self.release = int(head[tag(b"release") :][:3])
        self.order = "<" if head[tag(b"byteorder") :][:3] == b"LSF" else ">"
        width, k, n = _LAYOUT[self.release]
        number = lambda at, kind: int(np.frombuffer(head, np.dtype(self.order + kind), 1, at)[0])
        self.variables, self.rows = number(tag(b"K"), k), number(tag(b"N"), n)
        # Labels may be long, so the map is looked for behind them.
        while b"<map>" not in head or len(head) < tag(b"map") + 14 * 8:
            more = file.read(4096)
            if not more:
                raise ValueError("no map of the file")
            head += more
        places = np.frombuffer(head, np.dtype(self.order + "i8"), 14, tag(b"map"))
        file.seek(int(places[2]) + len(b"<variable_types>"))
        types = np.frombuffer(file.read(2 * self.variables), np.dtype(self.order + "u2"))
        file.seek(int(places[3]) + len(b"<varnames>"))
        names = [x.split(b"\0")[0].decode() for x in np.frombuffer(file.read(width * self.variables), f"S{width}").tolist()]
        self.data = int(places[9]) + len(b"<data>")
        kinds = [self.order + _TYPES[t][0] if t in _TYPES else "V8" if t == 32768 else f"V{t}" for t in types.tolist()]
        self.row = np.dtype({"names": names, "formats": kinds})
        self.missing = {name: _TYPES[t][1] for name, t in zip(names, types.tolist(), strict=True) if t in _TYPES}


class _StataReader(DataSourceReader):
    """Each partition seeks to its rows and reads them alone.  A file of an older release, which has no offsets, is one partition."""

    def __init__(self, path: str, columns: list[str], chunk: int, parts: int):
        self.path, self.columns, self.chunk, self.parts, self.taken = path, columns, chunk, parts, 0

    def _open(self):
        fs, path = opened(self.path)
        return fs.open_input_file(path)

    def partitions(self):
        with self._open() as file:
            try:
                head = StataHeader(file)
            except ValueError:
                return [_Rows(0, -1, 0, None)]
        if odd := [c for c in self.columns if c not in head.missing]:
            raise ValueError(f"no columns of numbers: {odd}")
        edges = [head.rows * i // self.parts for i in range(self.parts + 1)]
        part = [_Rows(a, b, head.data, head.row) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        return part or [_Rows(0, 0, head.data, head.row)]

    def _batch(self, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.float64(), from_pandas=True) for c in self.columns], names=self.columns)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        if partition.row is None:
            import pandas as pd

            with pd.read_stata(self.path, columns=self.columns, convert_categoricals=False, chunksize=self.chunk) as chunks:
                for part in chunks:
                    yield self._batch({c: part[c].to_numpy("float64", na_value=float("nan")) for c in self.columns})
            return
        limits = {name: limit for kind, limit in _TYPES.values() for name in self.columns if partition.row[name].str[1:] == kind}
        with self._open() as file:
            for at in range(first, last, self.chunk):
                size = min(self.chunk, last - at) * partition.row.itemsize
                file.seek(partition.data + at * partition.row.itemsize)
                rows = np.frombuffer(file.read(size), partition.row)
                self.taken += size
                columns = {}
                for c in self.columns:
                    values = rows[c].astype(np.float64)
                    values[values >= limits[c]] = np.nan
                    columns[c] = values
                yield self._batch(columns)


#: The FIPS codes of the 50 states and the District of Columbia.
FIPS = [n for n in range(1, 57) if n not in (3, 7, 14, 43, 52)]


class _State(InputPartition):
    def __init__(self, code: int):
        super().__init__(code)


class CensusSource(DataSource):
    """``format("census")``: a partition per state.  Options ``url`` (with ``{state}``) and ``columns``.  The service answers a
    JSON matrix with a header row; a state that fails fails the read, so a partial country is never taken for a whole one."""

    @classmethod
    def name(cls) -> str:
        return "census"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._columns())

    def reader(self, schema):
        return _CensusReader(self.options["url"], self._columns(), [int(s) for s in self.options.get("states", ",".join(map(str, FIPS))).split(",")])


class _CensusReader(DataSourceReader):
    def __init__(self, url: str, columns: list[str], states: list[int]):
        self.url, self.columns, self.states = url, columns, states

    def partitions(self):
        return [_State(s) for s in self.states]

    def read(self, partition) -> Iterator[tuple]:
        with urllib.request.urlopen(self.url.format(state=f"{partition.value:02d}"), timeout=120) as answer:
            head, *rows = json.load(answer)
        if not rows:
            raise ValueError(f"state {partition.value:02d} has no rows")
        at = [head.index(c) for c in self.columns]
        for r in rows:
            yield tuple(r[i] for i in at)


def register(spark) -> None:
    spark.dataSource.register(StataSource)
    spark.dataSource.register(CensusSource)
