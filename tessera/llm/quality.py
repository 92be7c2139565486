"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its lower-cased words hashed to WORDS slots, with damped
and normalised counts, and statistics of its form (sizes, shares of character
classes, repetition, lines), each put into one of BINS bins whose edges come
from the training sample. The pairwise part is scored in linear time by the
sum-of-squares identity, 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on at most SAMPLE labelled rows (those with the smallest
hashes of their ids) and SAMPLE_BYTES of their features, by one task; the
driver receives the fitted weights alone. Every row is scored. Labels,
language, source and id are never features.

Defined results: null texts count as empty and get the score of an empty text;
rows whose label is null are not learnt from; of several labels of one id the
mean counts, from a half up as 1; without labels every score is the prior 0.5;
repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _core as c

WORDS = 1 << 15
BINS = 8
RANK = 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Bytes of the features of these rows, at most: rows in the order of their hashes, up to the first that passes the bound.
SAMPLE_BYTES = 128 << 20
#: Bytes of text that a worker turns into features at a time.
PIECE = 1 << 21
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
STATISTICS = ("bytes", "words", "word_length", "distinct", "top_word", "upper", "digit", "space", "punctuation", "symbol", "bar", "exclamation", "other", "line_length", "repeats", "single")
SLOTS = WORDS + BINS * len(STATISTICS)

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "space": ~c.NONSPACE,
    "punctuation": np.isin(_B, [ord(x) for x in ".,;:?'\"()-"]),
    "symbol": np.isin(_B, [ord(x) for x in "#$%&*+/<=>@[\\]^_`{}~"]),
    "bar": _B == ord("|"),
    "exclamation": _B == ord("!"),
    "other": _B >= 128,
    "line": _B == 10,
}


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: (document, slot, value) of its words, sorted by document, and the table of statistics."""
    data, offsets = c.text_bytes(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    starts, ends, first = c.find_words(data, offsets, c.ALNUM)
    count = np.diff(first)
    doc = np.repeat(np.arange(n, dtype=np.int64), count)
    hashes = c.hash_spans(data, starts, ends)
    slot = (hashes >> np.uint64(64 - 15)).astype(np.int64)
    pairs, tf = np.unique(doc * WORDS + slot, return_counts=True)
    d, s = pairs // WORDS, pairs % WORDS
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(d, value * value, n))
    value = value / norm[d]

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    distinct = np.bincount(d, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d, tf)
    same = np.zeros(n)
    if len(hashes) > 1:
        same = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    some = np.maximum(count, 1)
    lines = share(_CLASSES["line"][data], np.ones(n)) + 1
    shares = {k: share(m[data], size) for k, m in _CLASSES.items() if k != "line"}
    stats = shares | {
        "bytes": np.log1p(size), "words": np.log1p(count), "word_length": np.bincount(doc, ends - starts, n) / some, "distinct": distinct / some, "top_word": top / some,
        "line_length": np.log1p(size / lines), "repeats": same / some, "single": np.bincount(d, tf == 1, n) / some,
    }
    return d, s, value, np.stack([stats[k] for k in STATISTICS], axis=1)


class Machine:
    """Bias b, weights w and factors v over all slots, and the bins' edges."""

    def __init__(self, edges: np.ndarray):
        rng = np.random.default_rng(7)
        self.edges, self.b = edges, 0.0
        self.w, self.v = np.zeros(SLOTS, np.float32), rng.normal(0, 0.02, (SLOTS, RANK)).astype(np.float32)

    def design(self, d, s, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and bins of all documents as (document, slot, value), sorted by document."""
        n = len(stats)
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(len(STATISTICS))], axis=1)
        bins = WORDS + BINS * np.arange(len(STATISTICS)) + bins
        # Each document's bins stand behind its words.
        words = np.bincount(d, minlength=n)
        total = words + bins.shape[1]
        docs = np.repeat(np.arange(n, dtype=np.int32), total)
        slots, values = np.empty(len(docs), np.int32), np.full(len(docs), 0.5, np.float32)
        is_word = np.ones(len(docs), bool)
        is_word[(np.cumsum(total)[:, None] - np.arange(bins.shape[1], 0, -1)).ravel()] = False
        slots[is_word], values[is_word], slots[~is_word] = s, value, bins.ravel()
        return docs, slots, values

    def raw(self, docs, slots, values, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(docs, np.arange(n))  # every document has its bins, so no document is without a row
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        linear = np.add.reduceat(self.w[slots] * values, at)
        return self.b + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, docs, slots, values, y: np.ndarray, steps: int = 900, rate: float = 0.1, decay: float = 1e-5, batch: int = 64) -> Machine:
        """Adagrad over small batches, at least ``steps`` of them and at least 4 times over the sample."""
        n, rng = len(y), np.random.default_rng(11)
        gw, gv, gb = np.full(SLOTS, 1e-3, np.float32), np.full((SLOTS, RANK), 1e-3, np.float32), 1e-3
        at = np.searchsorted(docs, np.arange(n + 1))
        self.b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        for _ in range(max(4, -(-steps * batch // n))):
            order = rng.permutation(n)
            for k in range(0, n, batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
                local = np.repeat(np.arange(len(own)), at[own + 1] - at[own])
                s, x = slots[rows], values[rows]
                z, sums = self.raw(local, s, x, len(own))
                err = ((1 / (1 + np.exp(-z)) - y[own]) / len(own)).astype(np.float32)
                e = err[local] * x
                used, where = np.unique(s, return_inverse=True)
                dw = np.bincount(where, e, len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.zeros((len(used), RANK), np.float32)
                np.add.at(dv, where, e[:, None] * (sums[local] - self.v[s] * x[:, None]))
                dv += decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(err.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.b -= rate * float(err.sum()) / gb**0.5
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        d, s, value, stats = featurise(texts)
        z, _ = self.raw(*self.design(d, s, value, stats), len(stats))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", sample_bytes: int = SAMPLE_BYTES) -> Machine | None:
    """Fit on at most ``sample`` labelled documents, and ``sample_bytes`` of their features, outside the held-out fold."""
    c.settle(documents.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (c.fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    chosen = chosen.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def parts(batches):
        for batch in c.pieces(batches, most=PIECE):
            d, s, value, stats = featurise(batch.column("text"))
            at = np.searchsorted(d, np.arange(batch.num_rows + 1))
            packed = [np.concatenate([stats[i].astype(np.float32).view(np.uint8), s[at[i] : at[i + 1]].astype(np.int32).view(np.uint8), value[at[i] : at[i + 1]].astype(np.float32).view(np.uint8)]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    # Rows that repeat an id count once, so a hot id can't pass the bound. The window is over the bounded sample.
    sampled = rows.mapInArrow(parts, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    running = F.sum(F.octet_length("x").cast("long")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    bounded = sampled.withColumn("bytes", running).where(F.col("bytes") <= sample_bytes).select(F.lit(0).alias("one"), "doc_id", "y", "x")
    found = bounded.groupBy("one").applyInArrow(fitted, "machine binary").collect()
    return pickle.loads(bytes(found[0]["machine"])) if found else None


def fitted(table: pa.Table) -> pa.Table:
    """The pickled machine of a sample of packed rows (doc_id, y, x)."""
    order, k, n = pc.sort_indices(table, [("doc_id", "ascending")]).to_numpy(), len(STATISTICS), table.num_rows
    blobs = table.column("x").combine_chunks()
    sizes = ((pc.binary_length(blobs).to_numpy() // 4 - k) // 2)[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    d = np.repeat(np.arange(n, dtype=np.int32), sizes)
    s, v, stats = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32), np.empty((n, k))
    for i in range(n):
        x, words = blobs[int(order[i])].as_buffer(), int(sizes[i])
        stats[i] = np.frombuffer(x, np.float32, k)
        s[at[i] : at[i + 1]] = np.frombuffer(x, np.int32, words, 4 * k)
        v[at[i] : at[i + 1]] = np.frombuffer(x, np.float32, words, 4 * (k + words))
    machine = Machine(np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(k)]))
    y = table.column("y").to_numpy()[order].astype(np.float32)
    design = machine.design(d, s, v, stats)
    del blobs, d, s, v
    machine.fit(*design, y)
    c.release()
    return pa.table({"machine": pa.array([pickle.dumps(machine)], pa.binary())})


def score(documents: DataFrame, machine: Machine | None, keep: list[str], name: str = "__score") -> DataFrame:
    """The columns ``keep`` of all rows, with a score (column ``name``, which must be none of theirs)."""
    c.settle(documents.sparkSession)
    kept = documents.select(*keep, *([] if "text" in keep else ["text"]))
    schema = kept.select(*keep).withColumn(name, F.lit(0.5).cast("double")).schema

    def parts(batches):
        for batch in c.pieces(batches, most=PIECE):
            scores = machine.score(batch.column("text")) if machine else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores)], [*keep, name])

    return kept.mapInArrow(parts, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine, ["doc_id"]).select("doc_id", (c.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
