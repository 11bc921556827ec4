"""NPZ archives as a Spark data source: a partition per (file, member), read by ranges, and a sink with renamed temporary files.

Options of ``format("npz")``: ``path`` (a folder or one file; any address that Arrow's file systems know), ``arrays`` (names
of members, comma-separated; all without it), ``mode`` (``rows``, or ``headers`` to read no array at all). Members that
are not asked for are neither read nor unpacked; a member is streamed, ``CHUNK`` bytes of it in memory at a time.
Temporary files (``*.tmp.npz``) are left out. A named member that a file lacks is an error.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 4 << 20
ROWS = "path string, name string, row long, value array<double>"
HEADERS = "path string, name string, dtype string, shape array<long>, packed_bytes long, scalar string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; plain paths are the machine's."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _names(path: str) -> list[str]:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".npz") and not f.base_name.endswith(".tmp.npz"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)


@dataclass
class Member(InputPartition):
    path: str
    name: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "rows")
        self.arrays = [a.strip() for a in options.get("arrays", "").split(",") if a.strip()]

    def partitions(self) -> list[Member]:
        """Files times members: what is listed here is names only; without ``arrays`` a file's directory is read by its task."""
        return [Member(p, a) for p in _names(self.path) for a in (self.arrays or [""])] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
            for name in [partition.name] if partition.name else [n[:-4] for n in z.namelist() if n.endswith(".npy")]:
                yield from (self._describe if self.mode == "headers" else self._rows)(partition.path, z, name)

    def _describe(self, path: str, z: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
        with z.open(f"{name}.npy") as stream:
            shape, _, dtype = _header(stream)
            scalar = None
            if shape == () and not dtype.hasobject:
                scalar = str(np.frombuffer(stream.read(dtype.itemsize), dtype)[0])
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string()]
        values = [path, name, dtype.str, list(shape), z.getinfo(f"{name}.npy").compress_size, scalar]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["path", "name", "dtype", "shape", "packed_bytes", "scalar"])

    def _rows(self, path: str, z: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
        with z.open(f"{name}.npy") as stream:
            shape, by_column, dtype = _header(stream)
            if dtype.hasobject or dtype.kind not in "biuf":
                raise ValueError(f"{name} of {path} holds {dtype}, not numbers")
            n, width = (shape[0], int(np.prod(shape[1:]))) if shape else (1, 1)
            if by_column and len(shape) > 1:  # columns lie one after another, so this one is read whole
                whole = np.frombuffer(stream.read(), dtype).reshape(shape, order="F").reshape(n, width)
                blocks = (whole[i : i + 4096] for i in range(0, n, 4096))
            else:
                step = max(1, CHUNK // max(1, width * dtype.itemsize))
                blocks = (np.frombuffer(stream.read(min(step, n - i) * width * dtype.itemsize), dtype).reshape(-1, width) for i in range(0, n if width else 0, step))
            at = 0
            for block in blocks:
                flat = block.astype(float).ravel()
                ends = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
                value = pa.ListArray.from_arrays(ends, pa.array(flat, mask=~np.isfinite(flat)))
                k = len(block)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([name] * k), pa.array(np.arange(at, at + k)), value], ["path", "name", "row", "value"])
                at += k


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return HEADERS if self.options.get("mode") == "headers" else ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, path: str, arrays: list[str] | None = None) -> DataFrame:
    """``path, name, row, value``: a row per entry along the first axis of each (named) array, 0-d ones as one row; non-finite entries are null."""
    spark.dataSource.register(NpzSource)
    reader = spark.read.format("npz")
    return (reader.option("arrays", ",".join(arrays)) if arrays else reader).load(path)


def headers(spark: SparkSession, path: str, arrays: list[str] | None = None) -> DataFrame:
    """``path, name, dtype, shape, packed_bytes, scalar``: what the headers say, and the values of 0-d arrays as text; no array is read."""
    spark.dataSource.register(NpzSource)
    reader = spark.read.format("npz").option("mode", "headers")
    return (reader.option("arrays", ",".join(arrays)) if arrays else reader).load(path)


def write(rows: DataFrame, path: str, scalars: dict[str, str] | None = None, block: int = 10_000) -> int:
    """Each task writes its rows as archives of at most ``block`` rows, an array a column; number of files.

    Numbers and arrays of equal length become numeric arrays (a null number: NaN; a null array is an error), ``scalars`` 0-d text. A file gets its name only
    once whole, and a repeated task writes its own names, of which only those of the attempt that counted are kept.
    """
    fixed = dict(scalars or {})

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = _open(path)
        fs.create_dir(at, recursive=True)
        for f in frames:
            for i in range(0, len(f), block):
                part = f.iloc[i : i + block]
                arrays = {c: np.array([np.nan if v is None else v for v in part[c].tolist()] if part[c].dtype != object else part[c].tolist(), float) for c in part.columns}
                name = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{name}.tmp.npz") as out:
                    np.savez_compressed(out, **arrays, **{k: np.array(v) for k, v in fixed.items()})
                yield pd.DataFrame({"name": [name]})

    kept = [r["name"] for r in rows.mapInPandas(store, "name string").collect()]  # a name per file
    fs, _ = _open(path)
    for name in kept:
        fs.move(f"{name}.tmp.npz", f"{name}.npz")
    return len(kept)
