"""What the corpus operators share: scratch tables, row ids and vectorised tokenising.

Texts reach Python as Arrow batches; one batch is handled as one byte buffer
with document offsets, so splitting into words and hashing run in numpy over
whole batches, without a Python loop over words or characters.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---------------------------------------------------------------- scratch

#: Bytes of an Arrow batch sent to Python, about; one row may be larger.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only where unset, a local one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written once and read again, which cuts lineage: a lost executor costs no more than its own tasks.

    ``put`` writes and rereads a table; ``drop`` removes tables that are no
    longer read; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.schemas: dict[str, StructType] = {}
        self.count = 0
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{name}-{self.count}"
        df.write.parquet(path)
        self.paths[name], self.schemas[name] = path, df.schema
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(self.paths[name])

    def rename(self, name: str, new: str) -> None:
        """The table ``name`` takes the place of the table ``new``, which goes."""
        self._remove(self.paths.get(new))
        self.paths[new], self.schemas[new] = self.paths.pop(name), self.schemas.pop(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.paths.pop(name, None))

    def close(self) -> None:
        atexit.unregister(self.close)
        self._remove(self.base)

    def _remove(self, path: str | None) -> None:
        try:
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended; the folder's owner cleans it
            pass


def _repeats(df: DataFrame) -> bool:
    """Whether every scan of ``df`` gives the same rows in the same partitions: a scan of files, projected and filtered."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation") or not plan.deterministic():
            return False
        todo += [plan.children().apply(k) for k in range(plan.children().length())]
    return True


def settle(spark: SparkSession) -> None:
    """Settings of a session that are not the user's own: splits of files don't follow the cores at hand, and Arrow batches are bounded in bytes, not only in rows."""
    wanted = {"spark.sql.files.minPartitionNum": max(1, spark.sparkContext.defaultParallelism), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for key, value in wanted.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def identified(df: DataFrame, scratch: Scratch, uid: str = "uid") -> DataFrame:
    """``df`` with a column of row ids that stay the same in every scan and every retried task.

    Ids count rows by partition, so partitions must repeat. A scan of files
    repeats them (its splits are settled); any other plan is written once and
    read again.
    """
    settle(df.sparkSession)
    if not _repeats(df):
        df = scratch.put(df, "rows")
    return df.withColumn(uid, F.monotonically_increasing_id())


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from the columns (in any case)."""
    taken, out = {x.lower() for x in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids give -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- tokens

#: Bytes of words as the contracts fix them: letters and digits after lower-casing, with every byte of other code points; or all but white space.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NONSPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

#: Bytes that are hashed at a time; hashes don't depend on it.
SEGMENT = 1 << 17
_MULT = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTES[LOWER]
#: For a second hash, independent of the first.
_SECOND = np.random.default_rng(20251103).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS["p"]) < n:
        m = 1 << (n - 1).bit_length()
        for key, base in (("p", _MULT), ("i", pow(_MULT, -1, 2**64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the documents' offsets in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str = "text", most: int = 1 << 21):
    """Batches cut between rows, so that each holds few bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Gives what a task has freed back to the system, as its worker may wait long for the next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = table[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[b] = mask[a], mask[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, lowered: bool = False, second: bool = False) -> np.ndarray:
    """H with H[0] = 0, so that (H[e] - H[s]) times the inverse power s depends on bytes s..e alone."""
    p, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum((_SECOND if second else _LOWERED if lowered else _BYTES)[data] * p[: len(data)], out=h[1:])
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowered: bool = True, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans sorted by start, in segments, so that long inputs need no long power tables. ``second``: others, of the bytes as they are."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + SEGMENT, "left"))
        h = prefix_hash(data[base : int(ends[i:j].max())], lowered, second)
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (h[e] - h[s]) * powers(SEGMENT)[1][s]
        i = j
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words (an array shorter by n - 1)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += words[j : j + count] * np.uint64((pow(_MULT, 3 * j + 1, 2**64) * 0xC2B2AE3D27D4EB4F) % 2**64 | 1)
    return mix(out)


def decode(data: np.ndarray, start: int, end: int, lowered: bool = True) -> str:
    return (LOWER[data[start:end]] if lowered else data[start:end]).tobytes().decode("utf-8", "replace")


def long_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.int64())
