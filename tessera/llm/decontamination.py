"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once: each block of documents becomes one stored row with
its terms (sorted hashes), and for each term the list of its positions in the
block. The index is partitioned by documents, lies in the shared folder and is
read again for every chunk of the benchmark; texts are read only once.

Search takes distinct windows of benchmark items. Term counts of the whole
index decide which of a window's terms is the rarest; in each block, the
offset-adjusted list of that term is intersected with those of the next rarest
ones, so that common words cost little. No posting is shuffled; what goes to
all executors is the benchmark, in chunks of bounded size that are built, sent
and forgotten one at a time.

Defined results: null and empty texts have no words and no hits; repeated rows
are documents of their own; items with null id or without words take no part,
and rows that repeat an item id count as one item; an empty benchmark hits
nothing; extra columns of any name are ignored by ``search`` and kept by
``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as c

#: Bytes of benchmark text in a chunk (its windows take about ten times as much in the driver and in each worker).
CHUNK_BYTES = 4 << 20
#: Candidate places that are intersected at a time.
CANDIDATES = 1 << 21
#: Ids of rows to drop that may be broadcast (8 bytes each).
BROADCAST_ROWS = 400_000
#: Places by which a word of a proximity match of the query may be off its own.
SLOP = 1
BLOCK = "uids array<long>, doc_ids array<long>, first array<long>, terms binary, ends binary, positions binary"
RESULT = "doc_id long, n_words long, spans array<struct<start:long,length:long>>, items array<string>, near_items array<string>"


# ---------------------------------------------------------------- index


def posted(batches):
    """Blocks of documents as postings: ``positions`` lists the places (words of the block) of each term in turn, up to ``ends``."""
    for batch in c.pieces(batches):
        data, offsets = c.text_bytes(batch.column("text"))
        starts, ends, first = c.find_words(data, offsets, c.ALNUM)
        terms, at = np.unique(c.hash_spans(data, starts, ends), return_inverse=True)
        positions = np.argsort(at, kind="stable").astype(np.int32)
        until = np.cumsum(np.bincount(at, minlength=len(terms))).astype(np.int32)
        lists = [pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in (batch.column("uid"), c.long_column(batch, "doc_id"), pa.array(first))]
        yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in (terms, until, positions))], ["uids", "doc_ids", "first", "terms", "ends", "positions"])


def index(documents: DataFrame, scratch: c.Scratch) -> DataFrame:
    """The stored index of rows (uid, doc_id, text)."""
    return scratch.put(documents.mapInArrow(posted, BLOCK), "postings")


def counted(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                terms, n = np.frombuffer(terms.as_buffer(), np.uint64), np.diff(np.frombuffer(ends.as_buffer(), np.int32), prepend=0)
                slot = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                known = vocabulary[slot] == terms
                total[slot[known]] += n[known]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    return run


# ---------------------------------------------------------------- windows


class Windows:
    """The distinct windows of some benchmark items: ``terms`` (numbers in the vocabulary, -1 behind short ones), and which items hold each."""

    def __init__(self, ids: list[str], texts: pa.Array, size: int):
        data, offsets = c.text_bytes(texts)
        starts, ends, first = c.find_words(data, offsets, c.ALNUM)
        self.vocabulary, seq = np.unique(c.hash_spans(data, starts, ends), return_inverse=True)
        names, item = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        self.names = pa.array(names.tolist(), pa.string())
        words = np.diff(first)
        many = np.where(words > 0, np.maximum(1, words - size + 1), 0)
        row = np.repeat(np.arange(len(words)), many)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(words[row], size)
        place = start[:, None] + np.arange(size)
        terms = np.where(np.arange(size) < length[:, None], seq[np.minimum(place, max(0, len(seq) - 1))] if len(seq) else -1, -1).astype(np.int32)
        self.terms, window = np.unique(terms, axis=0, return_inverse=True)
        self.lengths = (self.terms >= 0).sum(axis=1)
        pairs = np.unique(window.reshape(-1).astype(np.int64) * max(1, len(names)) + item[row])
        self.items, window = pairs % max(1, len(names)), pairs // max(1, len(names))
        self.held = np.searchsorted(window, np.arange(len(self.terms) + 1))

    def rank(self, counts: dict[int, int]) -> None:
        """Each window's places, those of the rarest terms in the whole index first."""
        n = np.array([counts.get(k, 0) for k in range(len(self.vocabulary))] or [0], np.int64)
        self.order = np.argsort(np.where(self.terms >= 0, n[self.terms], np.iinfo(np.int64).max), axis=1, kind="stable")


def chunks(benchmark: DataFrame, size: int, chunk_bytes: int) -> Iterator[Windows]:
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // chunk_bytes)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toArrow()
        if own.num_rows and len((w := Windows(own.column("id").to_pylist(), own.column("text").combine_chunks(), size)).terms):
            yield w


# ---------------------------------------------------------------- search


class Block:
    """One stored block against a vocabulary: ``at`` holds the vocabulary's term at each place (else -1), ``positions[ptr[t]:ptr[t] + n[t]]`` the places of term t."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, words: int, vocabulary: np.ndarray):
        slot = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = vocabulary[slot] == terms
        n = np.diff(ends, prepend=0)
        self.at = np.full(words, -1, np.int32)
        self.at[positions] = np.repeat(np.where(known, slot, -1), n)
        self.positions = positions
        self.ptr, self.n = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        self.ptr[slot[known]], self.n[slot[known]] = (ends - n)[known], n[known]


def matches(block: Block, w: Windows, doc_of: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of all places where a window's terms stand consecutively or, with a slop, each within so many places of its own."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(block.at)
    live = np.flatnonzero(((w.terms < 0) | (block.n[w.terms] > 0)).all(axis=1))
    counts = block.n[w.terms[live, w.order[live, 0]]]
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(np.cumsum(counts[i:]), CANDIDATES, "right")) + i)
        own, many = live[i:j], counts[i:j]
        win = np.repeat(own, many)
        rarest = w.order[own, 0]
        within = np.arange(len(win)) - np.repeat(np.cumsum(many) - many, many)
        start = block.positions[np.repeat(block.ptr[w.terms[own, rarest]], many) + within].astype(np.int64) - np.repeat(rarest, many)
        if slop:  # the rarest term may be off its place, too
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            win = np.repeat(win, 2 * slop + 1)
        fits = (start >= 0) & (start + w.lengths[win] <= n)
        win, start = win[fits], start[fits]
        fits = doc_of[start] == doc_of[start + w.lengths[win] - 1]
        win, start = win[fits], start[fits]
        exact = np.ones(len(win), bool)
        for k in range(0 if slop else 1, w.terms.shape[1]):
            offset = w.order[win, k]
            want = w.terms[win, offset]
            place = np.minimum(start + offset, n - 1)
            near = (want < 0) | (block.at[place] == want)
            if slop:
                exact &= near
                for delta in (d for x in range(1, slop + 1) for d in (-x, x)):
                    other = np.clip(place + delta, 0, n - 1)
                    near |= (block.at[other] == want) & (doc_of[other] == doc_of[start])
            win, start, exact = win[near], start[near], exact[near]
        found.append((win, start, exact))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)


def _named(w: Windows, doc: np.ndarray, win: np.ndarray, n: int) -> pa.Array:
    """The sorted names of the items with the windows found in each of n documents."""
    pairs = np.unique(doc * len(w.terms) + win)
    doc, win = pairs // len(w.terms), pairs % len(w.terms)
    many = w.held[win + 1] - w.held[win]
    at = np.repeat(w.held[win], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    both = np.unique(np.repeat(doc, many) * len(w.names) + w.items[at])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(both // len(w.names), np.arange(n + 1)).astype(np.int32)), w.names.take(pa.array(both % len(w.names))))


def searcher(w: Windows | None, slop: int):
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                uids, doc_ids, first = (batch.column(k)[row].values for k in ("uids", "doc_ids", "first"))
                first = first.to_numpy()
                n, words = len(uids), int(first[-1])
                if not w or not words:
                    empty = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
                    spans, items, near = pa.ListArray.from_arrays(empty.offsets, pa.array([], span)), empty, empty
                else:
                    terms, ends, positions = (np.frombuffer(batch.column(k)[row].as_buffer(), kind) for k, kind in (("terms", np.uint64), ("ends", np.int32), ("positions", np.int32)))
                    doc_of = np.repeat(np.arange(n), np.diff(first))
                    win, start, exact = matches(Block(terms, ends, positions, words, w.vocabulary), w, doc_of, slop)
                    items, near = (_named(w, doc_of[start[x]], win[x], n) for x in (exact, ~exact))
                    cover = np.zeros(words + 1, np.int32)
                    np.add.at(cover, start[exact], 1)
                    np.add.at(cover, start[exact] + w.lengths[win[exact]], -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    edge = (covered[1:] != covered[:-1]) | (doc_of[1:] != doc_of[:-1])
                    begin = np.flatnonzero(covered & np.concatenate([[True], edge]))
                    end = np.flatnonzero(covered & np.concatenate([edge, [True]])) + 1
                    d = doc_of[begin]
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - first[d]), pa.array(end - begin)], ["start", "length"]))
                yield pa.RecordBatch.from_arrays([uids, doc_ids, pa.array(np.diff(first)), spans, items, near], ["uid", "doc_id", "n_words", "spans", "items", "near_items"])
        c.release()

    return run


def looked_up(postings: DataFrame, benchmark: DataFrame, scratch: c.Scratch, size: int = 8, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per indexed row, as ``search`` returns them, with its uid."""
    schema, parts = "uid long, " + RESULT, []
    for w in chunks(benchmark, size, chunk_bytes):
        counts = postings.select("terms", "ends").mapInArrow(counted(w.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term of the chunk at most
        w.rank({r["term"]: r["n"] for r in counts})
        parts.append(scratch.put(postings.mapInArrow(searcher(w, slop), schema), "found"))
    if not parts:
        return postings.mapInArrow(searcher(None, slop), schema)
    near = F.array_except("near_items", "items")
    if len(parts) == 1:
        return parts[0].withColumn("near_items", near)
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    joined = union.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(x)).alias(x) for x in ("spans", "items", "near_items")))
    return joined.select("uid", "doc_id", "n_words", merged("spans").alias("spans"), *(F.array_sort(F.array_distinct(x)).alias(x) for x in ("items", "near_items"))).withColumn("near_items", near)


def search(documents: DataFrame, benchmark: DataFrame, size: int = 8, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document row: its words, the merged spans (in words) of exact window occurrences, the items with such
    windows, and with ``slop`` > 0 the other items with a window whose words all lie within so many places of their own,
    for some start inside the document (``near_items``)."""
    scratch = c.Scratch(documents.sparkSession)
    docs = c.identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    return looked_up(index(docs, scratch), benchmark, scratch, size, slop, chunk_bytes).drop("uid")


def merged(spans: str):
    """Overlapping or touching spans made one."""
    last = lambda acc: F.element_at(acc, -1)
    end = lambda x: x["start"] + x["length"]
    piece = lambda s, n: F.struct(s.alias("start"), n.alias("length"))
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:bigint,length:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["start"] + F.get(acc, F.size(acc) - 1)["length"], F.lit(-1)) >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(piece(last(acc)["start"], F.greatest(end(last(acc)), end(x)) - last(acc)["start"])))).otherwise(F.concat(acc, F.array(piece(x["start"], x["length"])))),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 8, most: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``documents``, all columns, that hold windows of at most ``most`` items."""
    scratch, columns = c.Scratch(documents.sparkSession), documents.columns
    (row,) = c.fresh(columns, "__row")
    rows = c.identified(documents, scratch, row)
    postings = index(rows.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    bad = scratch.put(looked_up(postings, benchmark, scratch, size, 0, chunk_bytes).where(F.size("items") > most).select("uid"), "bad")
    scratch.drop("postings", "found")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return rows.join(side, rows[row] == side["uid"], "left_anti").select(columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
hit AS (SELECT DISTINCT dg.r, dg.p, dg.n, bw.item FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
often AS (SELECT x, count(*) AS n FROM word GROUP BY x),
win AS (SELECT g, n, string_split(g, ' ') AS t FROM (SELECT DISTINCT g, n FROM bw)),
term AS (SELECT g, n, unnest(t) AS x, unnest(range(0, n)) AS k FROM win),
anchor AS (SELECT g, min(term.n) AS n, arg_min(x, often.n) AS x, arg_min(k, often.n) AS k FROM term JOIN often USING (x) GROUP BY g HAVING count(*) = min(term.n)),
start AS (SELECT DISTINCT a.g, a.n, word.r, word.p - a.k + o AS s FROM anchor a JOIN word USING (x), (SELECT unnest([-1, 0, 1]) AS o)),
inside AS (SELECT start.* FROM start JOIN d USING (r) WHERE s >= 1 AND s + n - 1 <= len(d.w)),
near AS (SELECT i.r, i.g FROM inside i JOIN term ON term.g = i.g JOIN word ON word.r = i.r AND word.x = term.x AND word.p BETWEEN i.s + term.k - 1 AND i.s + term.k + 1 GROUP BY i.r, i.g, i.s, i.n HAVING count(DISTINCT term.k) = i.n),
nears AS (SELECT r, count(*) AS n_near FROM (SELECT DISTINCT near.r, bw.item FROM near JOIN bw USING (g)) z WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.r = z.r AND hit.item = z.item) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN nears USING (r)
"""
