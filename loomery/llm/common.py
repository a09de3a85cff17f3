"""What the operators share: shipping code, shared storage, checked broadcasts, hashing of words."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows up to which a table that has been counted may be broadcast.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()
_opened: ContextVar[list[Scratch] | None] = ContextVar("_opened", default=None)


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="loomery-"), "loomery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "loomery")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. They cut lineage: a lost executor costs no more than a stage.

    What is returned may read them, so those that weren't dropped before go when the driver ends, or by close().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)
        self.at: dict[int, str] = {}
        if (found := _opened.get()) is not None:
            found.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        out._scratch = path  # keeps the id from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(t._scratch)

    def drop_from(self, first: int, *keep: DataFrame) -> None:
        """Delete all tables saved since n was `first`, but for these: nothing reads the others any more."""
        kept = {t._scratch for t in keep}
        for i in range(first, self.n):
            if (path := f"{self.root}/{i}") not in kept:
                self._delete(path)

    def close(self) -> None:
        """Delete the run's folder, if the session still runs."""
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing() -> Iterator[None]:
    """What is made inside is also read inside, to its end: the tables of runs opened here go at the end."""
    token = _opened.set([])
    try:
        yield
    finally:
        for s in _opened.get():
            s.close()
        _opened.reset(token)


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, which are counted; else df, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """How many groups hold rows if each should hold about so many."""
    return max(1, -(-rows // each))


_rng = np.random.default_rng(20240521)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which all bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POW[0]) < n:
        for i, p in enumerate((_P, _PINV)):
            a = _POW[i]
            step = a[-1:] * p
            _POW[i] = np.concatenate([a, a * step])
    return _POW[0][:n], _POW[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the text's UTF-8, with A-Z lowered, in order."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ws = _WS[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], ws, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[b]] * up[: len(b)], dtype=np.uint64)])
        return mix64((c[stop] - c[start]) * down[start] + (stop - start).astype(np.uint64))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: what else a table brings, whatever its name, stays out of the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def blocks(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many characters, at least one text in each."""
    lo = n = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if n and n + size > most:
            yield lo, i
            lo, n = i, 0
        n += size
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list], list[list]]], fields: StructType, text: str = "text") -> DataFrame:
    """Columns `keep` as they are, and new ones: make() runs once in a task, and what it returns turns whole texts into columns.

    Arrow batches go through in runs of bounded size; kept columns aren't converted, so no type loses anything.
    """
    ship(df.sparkSession)
    d = columns(df, *dict.fromkeys([*keep, text]))
    schema = StructType([d.schema[n] for n in keep] + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for lo, hi in blocks(texts):
                new = [pa.array(x, type=to_arrow_type(f.dataType)) for x, f in zip(of(texts[lo:hi]), fields.fields, strict=True)]
                old = [b.column(b.schema.get_field_index(n)).slice(lo, hi - lo) for n in keep]
                yield pa.RecordBatch.from_arrays(old + new, names=schema.names)

    return d.mapInArrow(run, schema)
