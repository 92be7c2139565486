"""Language-model scoring: token unigrams, and logistic mixing of hashed-context bit predictors with a memory of the whole corpus.

Unigram base. Token counts of the training rows are summed per worker and then
by a shuffle on token hashes. Tokens of high count (at most HEAVY of them, a
bound on what is broadcast) are looked up where the texts are read; all others
meet their counts in a join on the token.

Bit predictors. A byte is coded as the path to its leaf in a Huffman tree of
the corpus, so that a text is a row of bits (about 4.5 a byte, against 8 for
plain bits), each node of the tree being a binary decision; byte 255, which
UTF-8 never holds, ends a text. Three predictors count, for hashed contexts
(the last two bytes, the last three, and the last letters of the current
word), which bytes followed, and hence how often each node went right. Their
predictions in the logistic domain are combined by weights that the node
selects (the gate). Training documents come in two halves, each predicted by
what the other half counted. What the predictors said and what came is counted
for every decision, by node and GRID levels of each prediction; from these
counts the weights follow by Newton steps, and a last stage (adaptive
probability map) that refines mixed predictions by what followed such
predictions at that node. Whole numbers are summed, so it does not matter how
rows are dealt. Scoring predicts by the counts of both halves. These tables
have a fixed size, which is what is broadcast.

Positions are handled by symbol: all of one symbol take the same path, so that
a step reads one node's column of each table, which stays in cache.

Memory. What is learnt beyond that grows with the corpus and is never
broadcast whole. Texts are cut into phrases where a hash of the last REACH bytes
ends in zero bits (every 64 bytes or so), which the bytes before decide. The
phrases of all training texts are counted beside the tokens and joined in the
same way. A phrase costs what a mixture of its share of all phrases and of the
bit predictors gives; how much the memory is trusted is adapted to each text,
as a mixture over RATES. A training text's own phrases are taken out of the
counts before it is scored, as they would be if it were scored before it is
learnt; so a text is expected where others of the corpus hold it, too.

Defined results: null texts count as empty, whose only token and symbol is the
end; rows with a null id are scored, never learnt from and not held out;
without training tokens N is 0, V is 0 and all tokens are unknown; repeated
rows are learnt from and scored once per row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as c

FOLDS, HELD_OUT = 5, 1
#: Tokens whose counts are broadcast, at most.
HEAVY = 1 << 19
#: Hashed contexts of each predictor.
CONTEXTS = (1 << 14, 1 << 15, 1 << 15)
STARTS = np.concatenate([[0], np.cumsum(CONTEXTS)]) * 256
SEGMENT = 1 << 16
END = 255
#: Weight of every predictor before anything is learnt, what it counts for, and steps towards the learnt ones.
FIRST, PRIOR, STEPS = 0.45, 50.0, 12
#: Levels of each prediction by which decisions are counted, and how far they are apart.
GRID, APART = 16, 0.8
#: Bytes of text that a worker holds as symbols and contexts at a time: few enough to stay in cache, many enough for its steps to be long.
PIECE = 1 << 20
#: Positions of a symbol in a piece from which they are handled apart.
OFTEN = 2048
#: Predictions in the logistic domain are held in steps of 1 / UNIT, up to 16 either way.
UNIT = 256
LEVELS = 256
#: Bytes whose hash ends phrases, and its bits that must be zero.
REACH, ZEROS = 16, 6
#: Shares of the memory in a phrase's probability, which a text mixes.
RATES = (1 / 256, 1 / 4, 15 / 16)


# ---------------------------------------------------------------- unigrams


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of tokens are even; 0 is the end of texts, which is as unlikely as any other for a word."""
    return c.hash_spans(data, starts, ends) & ~np.uint64(1)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all phrases of all documents (at least one each, the last ending its text), their keys, which are odd, and their documents."""
    cuts = [np.zeros(0, np.int64)]
    for k in range(0, max(0, len(data) - REACH), c.SEGMENT):
        h = c.prefix_hash(data[k : k + c.SEGMENT + REACH])
        rolled = c.mix((h[REACH:] - h[:-REACH]) * c.powers(c.SEGMENT + REACH)[1][: len(h) - REACH])
        cuts.append(np.flatnonzero(rolled[: c.SEGMENT] >> np.uint64(64 - ZEROS) == 0) + (k + REACH))
    cut = np.concatenate(cuts)
    cut = cut[cut < offsets[-1]]
    doc = np.searchsorted(offsets, cut, "right") - 1
    inside = cut - REACH >= offsets[doc]  # all hashed bytes in this document
    cut, doc = cut[inside], doc[inside]
    n = len(offsets) - 1
    # Each document's first phrase starts with it; the others follow.
    doc, starts = np.concatenate([np.arange(n), doc]), np.concatenate([offsets[:-1], cut])
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if n else np.zeros(0, bool)
    ends = np.where(last, offsets[doc + 1], np.concatenate([starts[1:], [0]])) if n else starts
    key = c.hash_spans(data, starts, ends, lowered=False)
    key = c.mix(key + last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return starts, ends, key | np.uint64(1), doc


def count_tokens(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs = size = 0

    def out():
        h = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint64)
        n = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
        tokens, where = np.unique(h, return_inverse=True)
        return tokens, np.bincount(where, n, len(tokens)).astype(np.int64)

    def emit(tokens, n, docs):
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n), pa.array(np.concatenate([[docs], np.zeros(max(0, len(n) - 1))]).astype(np.int64)[: len(n)])], ["token", "n", "docs"])

    for batch in c.pieces(batches):
        data, offsets = c.text_bytes(batch.column("text"))
        starts, ends, _ = c.find_words(data, offsets, c.NONSPACE)
        held.append(np.unique(np.concatenate([word_keys(data, starts, ends), phrases(data, offsets)[2]]), return_counts=True))
        docs += batch.num_rows
        size += len(held[-1][0])
        if size > 1 << 22:
            held = [out()]
            size = len(held[0][0])
            if size > 1 << 21:
                yield emit(*held[0], 0)
                held, size = [], 0
    tokens, n = out()
    yield emit(np.concatenate([tokens, np.zeros(1, np.uint64)]), np.concatenate([n, [docs]]), 0)


def heavy_tokens(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of all tokens and phrases from some count up, at most ``most``; the count comes from a histogram of powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    found = {int(x["level"]): x["tokens"] for x in counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()}
    total, least = 0, None
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > most:
            break
        least = k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(level >= least).toArrow()
    h, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


# ---------------------------------------------------------------- bit predictors


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each followed by END, and the offsets of the documents in them."""
    data, offsets = c.text_bytes(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n, END, np.uint8)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[a + k : b + k] = data[a:b]
    return out, offsets + np.arange(n + 1)


#: Letters lower-cased; 0 for what stands in no word.
_LETTER = bytes(int(c.LOWER[b]) if c.ALNUM[b] and b != END else 0 for b in range(256))
_PLACE = np.random.default_rng(31).integers(0, 1 << 31, 256).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def contexts(sym: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each predictor's context at each position. What lies before a document is END."""
    prev = []
    for k in range(1, 4):
        p = np.full(len(sym), END, np.uint8)
        p[k:] = sym[:-k]
        for j in range(k - 1):  # right before the document stands the END of the one before
            at = offsets[:-1] + j
            p[at[at < offsets[1:]]] = END
        prev.append(p)
    p1, p2, p3 = (p.astype(np.uint32) for p in prev)
    two = p1 << np.uint32(8) | p2
    three = (two << np.uint32(8) | p3) * np.uint32(0x85EBCA6B)
    three ^= three >> np.uint32(15)
    # The letters of the current word: sums of letters weighted by their place, less the sum before the word.
    place = np.arange(len(sym), dtype=np.int32)
    letter = np.frombuffer(prev[0].tobytes().translate(_LETTER), np.uint8)
    before = np.maximum.accumulate(np.where(letter, np.int32(0), place))
    sums = np.cumsum(letter * _PLACE.take(np.minimum(place - before, 255)), dtype=np.uint32)
    word = sums - sums[before]
    word ^= word >> np.uint32(16)
    rows = [(two * np.uint32(0x9E3779B1)) >> np.uint32(18), (three * np.uint32(0xC2B2AE35)) >> np.uint32(17), (word * np.uint32(0x27D4EB2F)) >> np.uint32(17)]
    return [r.astype(np.int32) for r in rows]


def sparse(counts: np.ndarray):
    """Blobs (segment, packed places and counts) of a table that is mostly zero."""
    pack = zstandard.ZstdCompressor(level=3)
    rows = []
    for k in range(0, len(counts), SEGMENT):
        at = np.flatnonzero(counts[k : k + SEGMENT])
        if len(at):
            rows.append((k // SEGMENT, pack.compress(at.astype(np.uint16).tobytes() + counts[k + at].astype(np.int64).tobytes())))
    return rows


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 10
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.int64, n, 2 * n)


def add_blobs(table: pa.Table) -> pa.Table:
    """The sum of one segment's blobs."""
    total = np.zeros(SEGMENT, np.int64)
    for chunk in table.column("blob").iterchunks():
        for x in chunk:
            at, n = unpacked(x.as_py())
            total[at] += n
    blob = sparse(total)[0][1] if total.any() else b""
    return pa.table({"segment": table.column("segment").slice(0, 1), "part": table.column("part").slice(0, 1), "blob": pa.array([blob], pa.binary())})


def summed(blobs: DataFrame, fan: int) -> list:
    """One blob per segment, by way of ``fan`` partial sums of each, so that no task gathers all workers' blobs."""
    schema = "segment int, part int, blob binary"
    if fan > 1:
        blobs = blobs.groupBy("segment", "part").applyInArrow(add_blobs, schema)
    return blobs.groupBy("segment").applyInArrow(add_blobs, schema).collect()


def count_contexts(tables: np.ndarray, sym: np.ndarray, rows: list[np.ndarray]) -> None:
    for k, r in enumerate(rows):
        np.add.at(tables[STARTS[k] : STARTS[k + 1]], (r << 8) + sym, tables.dtype.type(1))


class Tree:
    """Huffman code of the symbols: ``path[s, t]`` is the node at step t, ``bit[s, t]`` the way taken; ``below`` and ``right`` say which symbols lie under each node."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        children = {}
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            node = 256 + len(children)
            children[node] = (x, y)
            heapq.heappush(heap, (a + b, node, node))
        codes: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        for node in sorted(children, reverse=True):
            for way, x in enumerate(children[node]):
                codes[x] = [*codes[node], (node - 256, way)]
        self.length = np.array([len(codes[s]) for s in range(256)], np.int16)
        deep = int(self.length.max())
        self.path, self.bit = np.zeros((256, deep), np.int32), np.zeros((256, deep), np.int32)
        self.below, self.right = np.zeros((256, 256), np.float32), np.zeros((256, 256), np.float32)
        for s in range(256):
            for t, (node, way) in enumerate(codes[s]):
                self.path[s, t], self.bit[s, t] = node, way
                self.below[s, node], self.right[s, node] = 1, way

    def stretched(self, counts: np.ndarray, kind, of) -> list[np.ndarray]:
        """For each predictor, by node and context: ``of`` (predictor, ln of the odds of going right by context and node)."""
        out = [np.empty((256, n), kind) for n in CONTEXTS]
        for j, n in enumerate(CONTEXTS):
            for k in range(0, n, 256):
                x = counts[STARTS[j] + 256 * k : STARTS[j] + 256 * (k + 256)].reshape(-1, 256).astype(np.float32)
                right = x @ self.right
                out[j][:, k : k + 256] = of(j, np.log((right + 0.4) / (x @ self.below - right + 0.4))).T
        return out

    def decisions(self, sym: np.ndarray, rows: list[np.ndarray]):
        """(positions, contexts, steps) of each frequent symbol, whose steps are (all, node, way), and of the others together, whose steps are (which, nodes, ways)."""
        order = np.argsort(sym, kind="stable")
        # One gather for all contexts.
        packed = rows[0].astype(np.int64)
        for r in rows[1:]:
            packed <<= 16
            packed |= r
        packed = packed[order]
        rows = [(packed >> 16 * k) & 0xFFFF for k in range(len(rows) - 1, -1, -1)]
        n = np.bincount(sym, minlength=256)
        ends = np.cumsum(n)
        for s in np.flatnonzero(n >= OFTEN).tolist():
            own = slice(int(ends[s] - n[s]), int(ends[s]))
            yield order[own], [r[own] for r in rows], [(slice(None), int(self.path[s, t]), int(self.bit[s, t])) for t in range(self.length[s])]
        rest = np.flatnonzero((n < OFTEN)[sym[order]])
        if len(rest):
            at = order[rest]
            s = sym[at]
            which = [np.flatnonzero(self.length[s] > t) for t in range(self.length[s].max())]
            yield at, [r[rest] for r in rows], [(x, self.path[s[x], t], self.bit[s[x], t]) for t, x in enumerate(which)]


def looked(table: np.ndarray, node, context: np.ndarray) -> np.ndarray:
    """Of a table by node and context: one node's values, or those of a node each."""
    return table[node].take(context) if isinstance(node, int) else table.ravel().take(node * table.shape[1] + context)


def levels(j: int, odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(odds / APART) + GRID // 2, 0, GRID - 1)


def learner(tree: Tree, tables):
    """Counts of decisions by node, way and levels; ``tables`` holds what each half counted, by which the other one is predicted."""

    def run(batches):
        total = None
        halves = (batch.filter(pc.equal(batch.column("half"), k)) for batch in batches for k in (0, 1))
        for batch in c.pieces(halves, most=PIECE):
            total = np.zeros((256, 2, GRID ** len(CONTEXTS)), np.int64) if total is None else total
            table = tables.value[1 - batch.column("half")[0].as_py()]
            sym, offsets = symbols(batch.column("text"))
            flat = total.reshape(-1)
            for _, rows, steps in tree.decisions(sym, contexts(sym, offsets)):
                for which, node, way in steps:
                    cell = np.zeros(len(rows[0][which]), np.int64)
                    for x, r in zip(table, rows, strict=True):
                        cell *= GRID
                        cell += looked(x, node, r[which])
                    if isinstance(node, int):
                        total[node, way] += np.bincount(cell, minlength=total.shape[2])
                    else:
                        np.add.at(flat, (2 * node.astype(np.int64) + way) * total.shape[2] + cell, 1)
        if total is not None:
            yield blobs(total.ravel())

    return run


def blobs(counts: np.ndarray) -> pa.RecordBatch:
    rows = sparse(counts)
    part = int(counts[: 1 << 16].sum()) & 0x7FFFFFFF
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["segment", "part", "blob"])


def learnt(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of decisions counted by (node, way, levels): the weights (node, predictor), and counts by (node, level of the mix, way)."""
    m = len(CONTEXTS)
    grid = np.stack(np.meshgrid(*[(np.arange(GRID) - GRID / 2 + 0.5) * APART] * m, indexing="ij")).reshape(m, -1)
    w, apm = np.full((256, m), FIRST), np.zeros((256, LEVELS // 8, 2))
    for node in np.flatnonzero(seen.any(axis=(1, 2))):
        n, right = seen[node].sum(axis=0), seen[node, 1]
        at = np.flatnonzero(n)
        x, n, right = grid[:, at], n[at], right[at]
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(w[node] @ x, -16, 16)))
            gradient = x @ (right - n * p) - PRIOR * (w[node] - FIRST)
            step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + PRIOR * np.eye(m), gradient)
            w[node] = np.clip(w[node] + np.clip(step, -0.3, 0.3), -0.5, 2)
        q = np.clip((w[node] @ x * 8).astype(np.int32) + LEVELS // 2, 0, LEVELS - 1) >> 3
        apm[node] = np.stack([np.bincount(q, n - right, LEVELS // 8), np.bincount(q, right, LEVELS // 8)], axis=1)
    return w, apm


def counter(batches):
    counts = None
    for batch in c.pieces(batches, most=PIECE):
        counts = np.zeros(STARTS[-1], np.int32) if counts is None else counts
        sym, offsets = symbols(batch.column("text"))
        count_contexts(counts, sym, contexts(sym, offsets))
    if counts is not None:
        yield blobs(counts)


class Model:
    """What scoring needs: the code tree, weighted predictions by predictor, node and context, and the cost in bits by node, way and mixed level."""

    def __init__(self, tree: Tree, counts: np.ndarray, seen: np.ndarray):
        w, apm = learnt(seen)
        self.tree = tree
        #: Decisions by node that taught the weights and the map.
        self.seen = seen.sum(axis=(1, 2))
        most = 32_000 // len(CONTEXTS)
        self.weighted = tree.stretched(counts, np.int16, lambda j, odds: np.clip(np.rint(odds * w[:, j].astype(np.float32) * UNIT), -most, most))
        centre = 1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS / 2 + 0.5) / 8))
        wide = np.repeat(apm, 8, axis=1)
        refined = (wide[:, :, 1] + 24 * centre) / (wide.sum(axis=2) + 24)
        p = np.clip((centre + refined) / 2, 1e-7, 1 - 1e-7)
        self.cost = -np.log2(np.stack([1 - p, p], axis=1)).astype(np.float32)

    def bits(self, column: pa.Array) -> np.ndarray:
        """Running sums of the bits of all symbols of all texts, each text's end among them."""
        sym, offsets = symbols(column)
        cost = np.zeros(len(sym) + 1)
        for at, rows, steps in self.tree.decisions(sym, contexts(sym, offsets)):
            bits = np.zeros(len(at), np.float32)
            for which, node, way in steps:
                dot = looked(self.weighted[0], node, rows[0][which])
                for x, r in zip(self.weighted[1:], rows[1:], strict=True):
                    dot += looked(x, node, r[which])
                dot >>= 5
                np.clip(dot, -LEVELS // 2, LEVELS // 2 - 1, out=dot)
                dot += LEVELS // 2
                bits[which] += self.cost[node, way].take(dot.astype(np.int64)) if isinstance(node, int) else self.cost[node, way, dot]
            cost[at + 1] = bits
        return np.cumsum(cost, out=cost)


def train_model(train: DataFrame) -> Model:
    """``train`` has columns doc_id and text."""
    spark = train.sparkSession
    half = F.pmod(F.crc32(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(2)).cast("int")
    texts = train.select(F.col("text").cast("string").alias("text"), half.alias("half"))
    schema = "segment int, part int, blob binary"
    fan = max(1, math.isqrt(train.rdd.getNumPartitions()))
    parts = lambda df: df.withColumn("part", F.pmod("part", F.lit(fan)))
    counts = np.zeros(STARTS[-1], np.int64)

    def add(rows, to: np.ndarray) -> None:
        for r in rows:
            if r["blob"]:
                at, n = unpacked(bytes(r["blob"]))
                to[r["segment"] * SEGMENT + at.astype(np.int64)] += n

    # Blobs are small, so that only one table is unpacked at a time.
    counted = [summed(parts(texts.where(F.col("half") == k).select("text").mapInArrow(counter, schema)), fan) for k in (0, 1)]
    for own in counted:
        add(own, counts)
    tree, tables = Tree(counts[: STARTS[1]].reshape(-1, 256).sum(axis=0)), []
    for own in counted:
        counts[:] = 0
        add(own, counts)
        tables.append(tree.stretched(counts, np.uint8, levels))
    shared = spark.sparkContext.broadcast(tables)
    seen = np.zeros(256 * 2 * GRID ** len(CONTEXTS), np.int64)
    add(summed(parts(texts.mapInArrow(learner(tree, shared), schema)), fan), seen)
    shared.destroy()
    counts[:] = 0
    add(counted[0], counts)
    add(counted[1], counts)
    return Model(tree, counts, seen.reshape(256, 2, -1))


# ---------------------------------------------------------------- both


def remembered(count, bits, phrases: int) -> list[np.ndarray]:
    """log2 of a phrase's probability at each of RATES, given its count elsewhere and its bits by the bit predictors."""
    out = []
    for rate in RATES:
        other = math.log2(1 - rate) - bits
        own = np.log2(np.maximum(count, 1) * (rate / max(1, phrases)))
        out.append(np.where(count > 0, np.logaddexp2(own, other), other))
    return out


def recalled(count, bits, phrases: int) -> list:
    """The same as Columns."""
    out = []
    for rate in RATES:
        other = F.lit(math.log2(1 - rate)) - bits
        own = F.log2(count * F.lit(rate / max(1, phrases)))
        out.append(F.when(count > 0, F.greatest(own, other) + F.log2(F.lit(1.0) + F.pow(F.lit(2.0), -F.abs(own - other)))).otherwise(other))
    return out


def score(documents: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document row: tokens, known tokens, N, the unigram and the model's log10 probability, and bits per byte."""
    spark, scratch = documents.sparkSession, c.Scratch(documents.sparkSession)
    part = c.fold(F.col("doc_id"), FOLDS)
    docs = c.identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch).withColumn("train", (part != HELD_OUT) & (part >= 0))
    train = docs.where("train").select("doc_id", "text")
    counts = train.select("text").mapInArrow(count_tokens, "token long, n long, docs long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")
    counts = scratch.put(counts, "counts")
    word = F.col("token").bitwiseAND(F.lit(1)) == 0
    total, distinct, all_phrases = counts.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum(F.when(word, F.col("n"))), F.count_if(word), F.sum(F.when(~word, F.col("n")))))).first()
    base = math.log10(total + 0.5 * (distinct + 1))
    hashes, many = heavy_tokens(counts, heavy)
    model = train_model(train)
    shared = spark.sparkContext.broadcast((hashes, many, model))
    ends = counts.where("token = 0").first()
    ends = ends["n"] if ends else 0
    rates = [f"rate_{k}" for k in range(len(RATES))]

    def common_counts(hashes, many, keys):
        """The counts of the keys that are broadcast, else -1."""
        if not len(hashes):
            return np.full(len(keys), -1)
        slot = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where(hashes[slot] == keys, many[slot], -1)

    def grouped(doc, key):
        """Distinct pairs of document and key, where each pair went, and how often it occurs."""
        order = np.lexsort((key, doc))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(key) else np.zeros(0, bool)
        where = np.empty(len(key), np.int64)
        where[order] = np.cumsum(new) - 1
        first = order[new]
        return doc[first], key[first], where, np.bincount(where, minlength=len(first))

    def run(batches):
        hashes, many, model = shared.value
        for batch in c.pieces(batches, most=PIECE):
            n = batch.num_rows
            uid, learnt = batch.column("uid").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            data, offsets = c.text_bytes(batch.column("text"))
            starts, stops, first = c.find_words(data, offsets, c.NONSPACE)
            doc, token, _, tf = grouped(np.repeat(np.arange(n), np.diff(first)), word_keys(data, starts, stops))
            count = common_counts(hashes, many, token)
            common = count >= 0
            own = np.bincount(doc[common], tf[common] * (np.log10(count[common] + 0.5) - base), n).astype(np.float64) + math.log10(ends + 0.5) - base
            known = np.bincount(doc[common], tf[common], n).astype(np.int64) + (ends > 0)
            # Phrases; a text's end belongs to its last one. Those of one key in one text share their mean cost.
            begin, end, key, holder = phrases(data, offsets)
            running = model.bits(batch.column("text"))
            final = np.concatenate([holder[1:] != holder[:-1], [True]]) if len(holder) else np.zeros(0, bool)
            bits = running[end + holder + final] - running[begin + holder]
            pdoc, pkey, where, ptf = grouped(holder, key)
            pbits = np.bincount(where, bits, len(pkey)) / np.maximum(ptf, 1)
            mine = np.where(learnt[pdoc], ptf, 0)
            pcount = common_counts(hashes, many, pkey)
            often = pcount >= 0
            sums = [np.bincount(pdoc[often], ptf[often] * x, n).astype(np.float64) for x in remembered(np.maximum(pcount[often] - mine[often], 0), pbits[often], all_phrases)]
            # A document's own row, then its rare tokens and phrases.
            rare = [np.concatenate([x[~common], y[~often]]) for x, y in ((doc, pdoc), (token, pkey), (tf, ptf), (np.zeros(len(doc), np.int64), mine), (np.zeros(len(doc)), pbits))]
            null = lambda values: pa.concat_arrays([values, pa.nulls(len(rare[0]), values.type)])
            also = lambda k, kind: pa.array(np.concatenate([np.zeros(n), rare[k]]).astype(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid, uid[rare[0]]])), null(batch.column("doc_id")), null(pa.array(np.diff(first).astype(np.int64) + 1)), null(pa.array(known)), null(pa.array(own)), null(pa.array(np.diff(offsets))), *(null(pa.array(x)) for x in sums),
                    pa.array(np.concatenate([c.mix(uid.astype(np.uint64) + np.uint64(1)), rare[1]]).view(np.int64)), also(2, np.int32), also(3, np.int32), also(4, np.float32),
                ],
                ["uid", "doc_id", "n_tokens", "known", "base", "bytes", *rates, "token", "tf", "own", "bits"],
            )

    rows = docs.mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, base double, bytes long, " + "".join(f"{x} double, " for x in rates) + "token long, tf int, own int, bits float")
    # A document's own row has tf 0 and a hash of its uid as token, so it passes the join without effect and without skew.
    elsewhere = F.greatest(F.coalesce("c", F.lit(0)) - F.col("own"), F.lit(0))
    joined = rows.join(counts.withColumnRenamed("n", "c"), "token", "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + F.sum(F.when(word & (F.col("c") > 0), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.when(word, F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - base)).otherwise(0.0))).alias("base_score"), F.max("bytes").alias("bytes"),
        *((F.max(name) + F.sum(F.when(~word & (F.col("tf") > 0), F.col("tf") * x).otherwise(0.0))).alias(name) for name, x in zip(rates, recalled(elsewhere, F.col("bits"), all_phrases), strict=True)),
    )
    best = F.greatest(*rates)
    log2 = best + F.log2(sum((F.pow(F.lit(2.0), F.col(x) - best) for x in rates), F.lit(0.0)) / len(RATES))
    scored = joined.withColumn("score", F.round(log2 * math.log10(2), 6))
    return scored.select("doc_id", (c.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
