"""Binary vector files as Spark data sources, and the small text formats around them.

Formats (little endian): `u8bin` and `fbin` (int32 n, d; n * d elements), `ibin` (int32 queries, k; ids; float32 distances), `spmat` (int64 rows,
columns, entries; int64 row starts; int32 columns; float32 values). Readers split a file by rows and read only their own part; files
must be where every executor sees them. Writers hold one file's header back until all rows are known.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of an input partition at most.
ROWS = 100_000


def peek(path: str) -> tuple[int, int]:
    """(n, d) of a u8bin, fbin or ibin file."""
    with open(path, "rb") as f:
        return struct.unpack("<ii", f.read(8))


class Part(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path = kind, options["path"].removeprefix("file:")
        self.limit, self.rows = int(options.get("limit", 1 << 62)), int(options.get("rows", ROWS))

    def count(self) -> int:
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            if self.kind == "spmat":
                n, _, entries = struct.unpack("<qqq", f.read(24))
                want = 24 + 8 * (n + 1) + 8 * entries
            else:
                n, d = struct.unpack("<ii", f.read(8))
                want = 8 + n * d * {"u8bin": 1, "fbin": 4, "ibin": 8}[self.kind]
        if size != want:
            raise ValueError(f"{self.path}: {size} bytes, its header says {want}")
        return min(n, self.limit)

    def partitions(self) -> list[Part]:
        n = self.count()
        return [Part(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.stop <= part.start:
            return
        with open(self.path, "rb") as f:
            if self.kind == "spmat":
                n, _, entries = struct.unpack("<qqq", f.read(24))
                f.seek(24 + 8 * part.start)
                at = np.frombuffer(f.read(8 * (part.stop - part.start + 1)), "<i8")
                f.seek(24 + 8 * (n + 1) + 4 * int(at[0]))
                flat = np.frombuffer(f.read(4 * int(at[-1] - at[0])), "<i4").astype(int).tolist()
                for i in range(part.stop - part.start):
                    yield part.start + i, flat[at[i] - at[0] : at[i + 1] - at[0]]
                return
            n, d = struct.unpack("<ii", f.read(8))
            rows = part.stop - part.start
            if self.kind == "ibin":
                f.seek(8 + 4 * d * part.start)
                ids = np.frombuffer(f.read(4 * d * rows), "<i4").reshape(rows, d)
                f.seek(8 + 4 * d * (n + part.start))
                dists = np.frombuffer(f.read(4 * d * rows), "<f4").reshape(rows, d)
                for i in range(rows):
                    yield from ((part.start + i, j + 1, int(r), float(x)) for j, (r, x) in enumerate(zip(ids[i], dists[i], strict=True)) if r >= 0)
                return
            kind = np.dtype("u1" if self.kind == "u8bin" else "<f4")
            f.seek(8 + kind.itemsize * d * part.start)
            block = np.frombuffer(f.read(kind.itemsize * d * rows), kind).reshape(rows, d).tolist()
            yield from ((part.start + i, v) for i, v in enumerate(block))


class Said(WriterCommitMessage):
    def __init__(self, path: str, rows: int, width: int, least: int) -> None:
        self.path, self.rows, self.width, self.least = path, rows, width, least


class Writer(DataSourceWriter):
    """Each task writes its rows (which must be in order and contiguous across tasks: sort by row first) to a part; the commit joins them."""

    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path, self.columns = kind, options["path"].removeprefix("file:"), int(options.get("columns", 0))

    def write(self, rows: Iterator) -> Said:
        from pyspark import TaskContext

        part = f"{self.path}.part-{TaskContext.get().partitionId():06d}"
        n, width, least = 0, -1, 1 << 62
        kind = {"u8bin": "u1", "fbin": "<f4", "spmat": "<i4"}[self.kind]
        with open(part, "wb") as out, open(f"{part}.sizes", "wb") as sizes:
            for r in rows:
                if self.kind != "spmat" and width >= 0 and len(r[1]) != width:
                    raise ValueError(f"row {r[0]} has {len(r[1])} components, not {width}")
                width, least = (len(r[1]) if self.kind != "spmat" else 0), min(least, r[0])
                out.write(np.asarray(r[1], dtype=kind).tobytes())
                sizes.write(struct.pack("<q", len(r[1])))
                n += 1
        return Said(part, n, width, least)

    def commit(self, said: list) -> None:
        parts = sorted((m for m in said if m is not None and m.rows), key=lambda m: m.least)
        n = sum(m.rows for m in parts)
        with open(self.path, "wb") as out:
            if self.kind == "spmat":
                sizes = np.concatenate([np.fromfile(f"{m.path}.sizes", "<i8") for m in parts] or [np.zeros(0, "<i8")])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
                out.write(struct.pack("<qqq", n, self.columns, int(ends[-1])) + ends.tobytes())
            else:
                out.write(struct.pack("<ii", n, max((m.width for m in parts), default=0)))
            for m in parts:
                with open(m.path, "rb") as f:
                    while block := f.read(1 << 24):
                        out.write(block)
            if self.kind == "spmat":
                out.write(np.ones(int(ends[-1]), "<f4").tobytes())
        self._clean()

    def abort(self, said: list) -> None:
        self._clean()

    def _clean(self) -> None:
        for p in glob.glob(f"{glob.escape(self.path)}.part-*"):
            os.remove(p)


def _source(kind: str, ddl: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return Reader(kind, self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(kind, self.options)

    return Source


SOURCES = {kind: _source(kind, ddl) for kind, ddl in (("u8bin", "row long, v array<int>"), ("fbin", "row long, v array<float>"), ("ibin", "qid long, rk int, row long, dist float"), ("spmat", "row long, tags array<int>"))}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def write_ibin(truth: DataFrame, path: str, k: int) -> None:
    """(qid, rk, row, dist) of queries 0..n-1 as an ibin file; missing neighbours get id -1 and the largest float. For truth sets a driver holds."""
    rows = truth.select("qid", "rk", "row", "dist").collect()
    n = max((r["qid"] for r in rows), default=-1) + 1
    ids, dists = np.full((n, k), -1, "<i4"), np.full((n, k), np.finfo("<f4").max, "<f4")
    for r in rows:
        if r["rk"] <= k:
            ids[r["qid"], r["rk"] - 1], dists[r["qid"], r["rk"] - 1] = r["row"], r["dist"]
    with open(path, "wb") as out:
        out.write(struct.pack("<ii", n, k) + ids.tobytes() + dists.tobytes())


#: File names of a dataset folder (fixed values).
NAMES = {"base": "base.10M.u8bin", "tags": "base.metadata.10M.spmat", "queries": "query.{set}.100K.u8bin", "query_tags": "query.metadata.{set}.100K.spmat", "truth": "GT.{set}.ibin"}


def dataset(spark: SparkSession, folder: str, which: str = "public") -> dict[str, DataFrame]:
    """The files of a folder by role; absent ones (a truth, say) are left out."""
    register(spark)
    found = {}
    for role, name in NAMES.items():
        path = os.path.join(folder, name.format(set=which))
        if os.path.exists(path):
            found[role] = spark.read.format(path.rsplit(".", 1)[1]).load(path)
    return found


def read_runbook(path: str, name: str) -> tuple[int, list[dict]]:
    """(max_pts, steps 1..n in order) of a dataset in a runbook file."""
    import yaml

    with open(path) as f:
        book = yaml.safe_load(f)[name]
    return int(book.get("max_pts", 0)), [book[i] for i in sorted(k for k in book if isinstance(k, int))]


OUTCOMES = "q long, hits int, possible int, latency_us double, scored long, matches long, ntags int"


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    outcomes.select(*[c.split()[0] for c in OUTCOMES.split(", ")]).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTCOMES).csv(path, sep="\t", header=True)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
