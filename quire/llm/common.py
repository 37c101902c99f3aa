"""What the training-data operators share: tokens, row keys, shared storage."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that part words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")  # one machine, as in tests
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to shared storage and read it again."""
    return Scope().stage(df, name)


class Scope:
    """Staged tables that can be deleted once what was made of them is staged as well."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(df.sparkSession, name)
        df.write.parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = back, path
        return back

    def leave(self, df: DataFrame, name: str) -> DataFrame:
        """Stage a result and delete everything else that this scope holds."""
        result = self.stage(df, name)
        for other, _ in list(self.paths.values()):
            if other is not result:
                self.drop(other)
        return result

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that this scope staged; other tables are left alone."""
        back, path = self.paths.pop(id(df), (None, None))
        if back is None:
            return
        spark = back.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Shared:
    """A broadcast value whose classes travel by value too, as functions do; a task should
    read ``value`` once."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.held.value)


#: Rows of a batch handled at once, so that what is made of their texts stays small.
ROWS = 1024


def slices(batches):
    """Arrow batches in runs of at most ``ROWS`` rows; the rows themselves are not copied."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def release() -> None:
    """Give freed memory back to the system. A function that came by value, with its tables, is
    freed by a collection only; the allocators keep what is free until they are asked."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return  # a C library that has none
    trim(0)


def lean(function):
    """``function`` over a task's batches, after which the worker, which is kept for other tasks
    and counts beside them, holds no more than it needs."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def map_ids(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over Arrow batches, where ids need not become Python or numpy numbers.

    It yields (ids, columns): the first column of the result, taken from the batch as Arrow, so
    that null and large ids come back as they are; and the others, as lists or arrays."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for ids, columns in function(batches):
            rest = [
                x if isinstance(x, pa.Array) else pa.array(x, kind)
                for x, kind in zip(columns, kinds.types[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=kinds.names)

    return df.mapInArrow(lean(run), schema)


def key_text(column: str) -> Column:
    """An identifier as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str, modulus: int, remainder: int = 2) -> Column:
    return (F.crc32(key_text(column).cast("binary")) % modulus) == remainder


def words(text: Column) -> Column:
    """Words of a text, as an array; null text has none."""
    return F.coalesce(
        F.array_remove(F.split(text, BLANK_RUN), ""), F.array().cast("array<string>")
    )


#: Bytes hashed at once; a longer text is cut between words.
HASH_PIECE = 1 << 18
_is_blank = np.zeros(256, bool)
_is_blank[list(BLANKS.encode())] = True
_byte_value = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(
                    np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64
                )
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, by running polynomial sums."""
    if len(data) <= HASH_PIECE:
        return _word_hashes(data)
    found, a = [], 0
    while a < len(data):
        b = a + HASH_PIECE
        while b < len(data) and not _is_blank[data[b]]:
            b += 1
        found.append(_word_hashes(data[a:b]))
        a = b
    return np.concatenate(found)


def _word_hashes(data: bytes) -> np.ndarray:
    code = np.frombuffer(data, np.uint8)
    blank = _is_blank[code]
    edge = np.ones(len(code) + 2, bool)
    edge[1:-1] = blank
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(code))
    sums = np.zeros(len(code) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_value[code] * power, out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverse[starts])


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; fewer words are one window."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            out = mix64(out * _STEP + word_hashes[k : n - width + 1 + k])
    return out
