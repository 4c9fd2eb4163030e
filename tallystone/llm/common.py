"""Shared plumbing: the cluster's shared folder, Arrow access, and numpy routines over UTF-8 bytes."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that one numpy step works on; a longer document makes its own step.
CHUNK = 2 << 20
#: Rows of an Arrow batch. Documents are long, and Spark's default of 10,000 rows is for short ones.
BATCH_ROWS = 1000


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/tallystone"
    return base.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def mark() -> int:
    """A point in the sequence of stored tables, for release."""
    return len(_written)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables that were stored since a mark, but for those in keep: nothing may read the others any more."""
    kept = {k._stored_at for k in keep}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in _written[since:] if p not in kept]:
        place = files.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


#: Tasks that a table of few rows gets at most, and rows that a further task is worth.
FEW_TASKS, TASK_ROWS = 32, 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than that many rows are worth: small tables in many rounds must not cost a task and a file a shuffle partition each."""
    return df.coalesce(max(FEW_TASKS, rows // TASK_ROWS))


#: Keys that a join looks up from a broadcast table are fewer than HOT_KEYS: each holds more than that share of all
#: rows, and more than HOT_ROWS of them. A shuffled key holds less.
HOT_KEYS, HOT_ROWS = 50_000, 2_000


def lookup(left: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", small: int = 0, shuffled: bool = False) -> DataFrame:
    """left joined with a stored table of one row a key, in which n is about the number of left's rows of that key.

    A table of at most `small` rows is broadcast. Otherwise its hot keys are, a number that HOT_KEYS bounds whatever the
    size, and the rest is shuffled, so that no task gets all rows of a hot key. With shuffled that is so for small tables
    too, so that a plan does not change with the size. n is not in the result.
    """
    if small and table.count() <= small:
        return left.join(F.broadcast(table.drop("n")), keys, how)
    total = table.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, total / HOT_KEYS)
    hot, cold = table.where(F.col("n") > least).drop("n"), table.where(F.col("n") <= least).drop("n")
    cold = cold.hint("merge") if shuffled else cold
    if not hot.limit(1).count():
        return left.join(cold, keys, how)
    out = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return out.unionByName(left.join(F.broadcast(hot), keys))


def small_batches(spark: SparkSession) -> None:
    """Gets Python workers ready: Arrow batches of at most BATCH_ROWS rows, so that a batch of long documents fits one."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most size bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes with table[byte], never across rows."""
    inside = table[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(buf)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 256


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end).

    Eight bytes at a time are mixed into a state that starts from the length. Spans of one length up to 8 bytes never
    collide, two others do with a probability of 2**-64, unless they are made to: whoever knows the seed can do that (see
    secret_hashes).
    """
    return byte_hash_lanes(buf, starts, ends, (seed,))[0]


def byte_hash_lanes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """byte_hashes for several seeds at once."""
    n = ends - starts
    padded = np.zeros(len(buf) // 8 + 2, np.uint64)
    padded.view(np.uint8)[: len(buf)] = buf

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = padded[k] >> shift | padded[k + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return x & _TAIL[np.minimum(left, 8)]

    x, size = load(starts, n), n.astype(np.uint64)
    out = [mix(x ^ mix(size + mix(np.array([seed], np.uint64)))) for seed in seeds]
    live, at = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(live):
        x = load(starts[live] + at, n[live] - at)
        for h in out:
            h[live] = mix(h[live] ^ x)
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > _LONG).tolist():
        part = buf[starts[i] : ends[i]].tobytes()
        for h, seed in zip(out, seeds, strict=True):
            h[i] = int.from_bytes(hashlib.blake2b(part, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def drawn() -> tuple[int, int]:
    """Two secret seeds, for secret_hashes: one use of an operator draws its own on the driver and sends them with its tasks."""
    return int.from_bytes(os.urandom(8), "little"), int.from_bytes(os.urandom(8), "little")


def secret_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, int]) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), from seeds that whoever wrote the bytes does not know.

    With a known seed, byte_hashes can be inverted a step at a time, so that spans with equal hashes can be made. Here
    two lanes of it with their own secret seeds are multiplied to 128 bits, and both halves folded into one.
    """
    a, b = byte_hash_lanes(buf, starts, ends, seeds)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    cross, other = a0 * b1, a1 * b0
    middle = (a0 * b0 >> half) + (cross & low) + (other & low)
    return a * b ^ (a1 * b1 + (cross >> half) + (other >> half) + (middle >> half))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def run_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of runs of n (at most 64) 64-bit hashes: a sum with an odd factor for each place."""
    total = np.full(len(starts), n, np.uint64)
    for k in range(n):
        total += values[starts + k] * _FACTORS[k]
    return mix(total)


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
