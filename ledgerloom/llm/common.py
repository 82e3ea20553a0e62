"""What the operators of this subpackage share: tables, intermediate storage and text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: The ASCII white space of the contracts, [\x20\x09-\x0D]; bytes.split() and bytes.strip() use the same set.
SPACE = b" \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local[...] session may lack the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='llm-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(_sweep)


#: Whether Spark deletes a query's shuffle files when it ends; else they stay until the driver's memory is collected.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. The write's shuffle files
    are deleted once it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    before = spark.conf.get(_CLEANS, None)
    spark.conf.set(_CLEANS, "true")
    try:
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANS)
        else:
            spark.conf.set(_CLEANS, before)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that hold more than one of HOT rows are joined by broadcast; there are fewer than HOT of them, whatever the input.
HOT = 1 << 14


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with the columns of counts, which has one row for each key and in `weight` how many of the `total` rows
    have it at least. Hot keys stay where their rows are read: they are neither shuffled nor gathered in a task."""
    hot, cold = counts.where(F.col(weight) > total // HOT), counts.where(F.col(weight) <= total // HOT)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return near.unionByName(far)


def importable(df: DataFrame) -> DataFrame:
    """Let Python workers that see this checkout import the package; elsewhere ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return df


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes; a row larger than that is alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def trim() -> None:
    """Give memory that is free in this process back to the system: idle Python workers count against their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)
_owner = ""
_releases: list[Callable[[], None]] = []


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called by a task in its Python worker: what another operator has kept in this worker is released first. `release`
    drops what the caller is about to keep."""
    global _owner
    if owner != _owner:
        while _releases:
            _releases.pop()()
        _owner = owner
        gc.collect()
        trim()
    if release and release not in _releases:
        _releases.append(release)


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def map_chunks(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str | StructType, *, column: str = "text", most: int = 4 << 20) -> DataFrame:
    """mapInArrow over row slices whose `column` (string or binary) holds about `most` bytes; work gives the columns of
    `schema` by name, as Arrow arrays, numpy arrays or lists. Columns that it passes through keep their exact values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(work.__module__)
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, most):
                out = work(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, target.field(n).type) for n, x in out.items()], names=[plain[n] for n in out])
            batch = out = None
        trim()

    kinds = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names, target = df.columns, to_arrow_schema(kinds)
    plain = {n: f"c{i}" for i, n in enumerate(kinds.names)}  # mapInArrow can't name a column that holds a dot
    given = StructType([StructField(plain[f.name], f.dataType) for f in kinds])
    return importable(df).toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, given).toDF(*kinds.names)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_codes(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of each n-byte window, composed from windows of powers of two; equal windows, equal codes."""
    step = _U(0x9E3779B97F4A7C15)
    part, size, out, have = mix64(raw.astype(_U) + _U(1)), 1, None, 0
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                m = len(raw) - have - size + 1
                out = out[:m] * _U(pow(int(step), size, 1 << 64)) + part[have : have + m] if m > 0 else np.zeros(0, _U)
            have += size
        if have == n:
            return out[: max(0, len(raw) - n + 1)]
        m = len(raw) - 2 * size + 1
        if m <= 0:
            return np.zeros(0, _U)
        part = part[:m] * _U(pow(int(step), size, 1 << 64)) + part[size : size + m]
        size *= 2


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs; touching intervals merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[first], e[np.r_[first[1:] - 1, len(s) - 1]]


def ragged_arange(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    offset = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return np.arange(total, dtype=np.int64) + offset
