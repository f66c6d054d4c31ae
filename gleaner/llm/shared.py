"""What several operators of this subpackage need: settled tables, words, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters that are neither a space nor one of tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: The same in Spark's SQL, for split().
GAP_SQL = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def lowered(text: str) -> str:
    """A-Z to a-z; nothing else changes."""
    return text.translate(_LOWERED) if not text.islower() else text


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a
    local master gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    saved = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled to make the table is of no more use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, saved)
    return spark.read.schema(df.schema).parquet(path)


def pieces_of(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes, so that Python objects of few rows live at a time."""
    rows = batch.num_rows
    step = max(1, int(rows * most_bytes / max(batch.nbytes, 1))) if batch.nbytes > most_bytes else rows
    for at in range(0, rows, max(step, 1)):
        yield batch.slice(at, step)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow of work, which turns a slice of a batch, whose columns it knows by place, into columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                columns = work(part)
                yield pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in arrow], schema=arrow)

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # mapInArrow takes no names with dots
    return plain.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (multiply and shift, three rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, made when first asked for; forgets all when it has grown to most."""

    def __init__(self, most: int = 300_000, seed: int = 0) -> None:
        super().__init__()
        import xxhash

        self.most, self.seed, self.make = most, seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word.encode("utf-8", "surrogatepass"), seed=self.seed)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = _powers(base, max(n, 1 << 16))
    return _kept[base][:n]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start the hash of width consecutive items: sum of h[i+k] * BASE**k modulo 2**64,
    mixed. One pass of running sums, whatever the width."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, n), dtype=np.uint64, out=running[1:])
        return mixed((running[width:] - running[:-width]) * powers(BASE_INVERSE, n)[: n - width + 1])
