"""N-gram Jaccard join by MinHash banding.

A document's shingles are its runs of five words (lower-cased; a shorter text
has one shingle of all its words). Rows with equal shingle sets are folded to
one representative first. Representatives get MinHash signatures, cut into
bands; the numbers of bands and rows are the cheapest whose recall at the
similarity threshold reaches the target. Band hashes are shuffled without
texts; buckets of one are dropped; the others link their members into
candidate groups (components), so that a document's shingles travel once to
wherever its candidates are, not once per band.

Pairs that share a band are verified on their full shingle sets inside groups,
by integer matrix products of the shared shingles. A group of more than
GROUP_ROWS rows or GROUP_SHINGLES shingles is cut into blocks, and every pair
of blocks is a task of its own; if its buckets are together cheaper than all
pairs, they are taken one by one, a pair counting in its first shared band
only. No pair is ever emitted: a block gives each row its number of links and
its component among verified links.

Defined results: null texts and texts without words are linked to nothing;
repeated rows are documents of their own, linked to each other; documents with
null ids take part (a class whose ids are all null has class id null); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as c
from tessera.llm._graph import components

SHINGLE = 5
#: Similarity 0.8, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.9999
GROUP_ROWS = 1024
GROUP_SHINGLES = 1 << 21
#: Wanted rows (24 bytes each) that may be broadcast to the scan of the texts.
BROADCAST_ROWS = 400_000


def bands_for(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows) of the steepest banding with at most ``most`` hashes whose recall at the threshold is reached."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within the limit reaches that recall")
    return best


BANDS, ROWS = bands_for(NUMERATOR / DENOMINATOR, RECALL)
_RNG = np.random.default_rng(5)
_A = (_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_X = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = c.text_bytes(column)
    starts, ends, first = c.find_words(data, offsets, c.ALNUM)
    words = c.hash_spans(data, starts, ends)
    g = c.grams(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        else:
            out.append(c.grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Band hashes."""
    least = np.full(len(_A), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):
        part = shingles[k : k + 4096]
        least = np.minimum(least, ((part[None, :] ^ _X[:, None]) * _A[:, None]).min(axis=1))
    rows = c.mix(least).reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = c.mix(total + rows[:, k])
    return total


def sign(batches):
    for batch in c.pieces(batches):
        digest, bands, size, memo = [], [], [], {}
        for s in shingle_sets(batch.column("text")):
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
            if d is not None and d not in memo:
                memo[d] = signature(s).view(np.int64)
            digest.append(d)
            size.append(len(s))
            bands.append(memo.get(d))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["uid", "doc_id", "digest", "shingles", "bands"])


def shingled(batches):
    for batch in c.pieces(batches):
        blobs = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        rest = [k for k in batch.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(blobs, pa.binary())], [*rest, "set"])


def verify_group(uid, copies, bands, sets, left, right, band: int):
    """Links of one group. ``left`` and ``right`` say which rows stand on either side; with all on both, pairs are those of different rows."""
    lengths = np.array([len(s) for s in sets], np.int64)
    values, where, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    column = np.cumsum(many > 1) - 1
    keep = many[where] > 1
    row, column = row[keep], column[where[keep]]
    width = int((many > 1).sum())
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    same = np.zeros((len(a), len(b)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(256, min(8192, (1 << 24) // max(1, len(sets))))
    for k in range(0, width, step):
        i, j = np.searchsorted(column, [k, k + step])
        x = np.zeros((len(sets), min(step, width - k)), np.float32)
        x[row[i:j], column[i:j] - k] = 1
        same += x[a] @ x[b].T
    # |A and B| / |A or B| >= n / d, in integers.
    linked = (NUMERATOR + DENOMINATOR) * same >= NUMERATOR * (lengths[a][:, None] + lengths[b][None, :])
    linked &= uid[a][:, None] != uid[b][None, :]
    i, j = np.nonzero(linked)
    shared = bands[a[i]] == bands[b[j]]
    good = shared.any(axis=1) if band < 0 else shared.argmax(axis=1) == band
    good &= shared.any(axis=1)
    i, j = i[good], j[good]
    links = np.bincount(a[i], copies[b[j]], len(uid))
    if not np.array_equal(left, right):  # of two blocks, either side counts
        links += np.bincount(b[j], copies[a[i]], len(uid))
    root = np.arange(len(uid))
    while len(i):  # least linked row, until nothing changes
        new = root.copy()
        np.minimum.at(new, a[i], root[b[j]])
        np.minimum.at(new, b[j], root[a[i]])
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return links.astype(np.int64), uid[root]


def verify(table: pa.Table) -> pa.Table:
    table = table.sort_by([("gid", "ascending"), ("i", "ascending"), ("j", "ascending"), ("band", "ascending"), ("uid", "ascending")]).combine_chunks()
    key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in ("gid", "i", "j", "band")])
    cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
    uid, copies, block = (table.column(k).to_numpy() for k in ("uid", "copies", "block"))
    bands = np.stack(table.column("bands").to_numpy())
    blobs = table.column("set")
    out_uid, out_links, out_root = [], [], []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        if e - s < 2:
            continue
        _, i, j, band = key[:, s]
        sets = [np.frombuffer(blobs[k].as_py(), np.uint64) for k in range(s, e)]
        links, root = verify_group(uid[s:e], copies[s:e], bands[s:e], sets, block[s:e] == i, block[s:e] == j, int(band))
        hit = links > 0
        out_uid.append(uid[s:e][hit])
        out_links.append(links[hit])
        out_root.append(root[hit])
    empty = [np.zeros(0, np.int64)]
    c.release()
    return pa.table({"uid": np.concatenate(out_uid or empty), "links": np.concatenate(out_links or empty), "root": np.concatenate(out_root or empty)})


def groups(reps: DataFrame, scratch: c.Scratch, group_rows: int, group_shingles: int) -> DataFrame:
    """Rows (uid, gid, i, j, block, band, alone): which rows meet in which task, all tasks of bounded size; pairs of blocks are tasks of their own."""
    banded = reps.select("uid", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("uid").alias("root"), F.count("*").alias("n")).where("n > 1")
    member = scratch.put(banded.join(buckets, ["band", "hash"]).select("uid", "band", "hash", "root", "n"), "buckets")
    comp = components(member.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    comp = scratch.put(comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    placed = comp.join(reps.select(F.col("uid").alias("node"), "shingles"), "node")
    sizes = placed.groupBy("root").agg(F.count("*").alias("m"), F.sum("shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / group_rows), F.ceil(F.col("s") / group_shingles)).cast("int")
    sizes = scratch.put(sizes.withColumn("b", blocks), "sizes")
    small = comp.join(sizes.where("b = 1"), "root").select(F.col("node").alias("uid"), F.col("root").alias("gid"), *(F.lit(0).alias(x) for x in ("i", "j", "block")), F.lit(-1).alias("band"), F.lit(False).alias("alone"))
    large = sizes.where("b > 1")
    if not large.limit(1).count():
        return small
    # Pairs in all blocks of the component, against pairs in its buckets.
    cost = member.groupBy("band", "hash", "root", "n").agg(F.lit(1).alias("one")).join(comp.withColumnRenamed("root", "comp"), F.col("root") == F.col("node")).groupBy("comp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    large = scratch.put(large.join(cost, F.col("root") == F.col("comp")).select("root", "m", "s", "b", (F.col("m").cast("double") * F.col("m") <= F.col("cost")).alias("whole")), "large")
    inside = comp.join(large, "root")
    whole = inside.where("whole").select(F.col("node").alias("uid"), F.col("root").alias("gid"), "b", F.lit(-1).alias("band"))
    average = F.ceil(F.col("s") / F.col("m"))
    width = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("n") * average / group_shingles)).cast("int")
    single = member.join(inside.where(~F.col("whole")).select(F.col("node").alias("uid"), "m", "s"), "uid").select("uid", F.col("hash").alias("gid"), width.alias("b"), "band")
    many = whole.unionByName(single).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("b")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("uid", "gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", (F.col("b") > 1).alias("alone"))
    return small.unionByName(many)


def join(documents: DataFrame, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per document row: uid, root (the same for all rows reached by links, and for no others), doc_id, class_id (least id among those rows) and n_links (rows linked to it)."""
    scratch = c.Scratch(documents.sparkSession)
    docs = c.identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    return joined(docs, scratch, group_rows, group_shingles)


def joined(docs: DataFrame, scratch: c.Scratch, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``join`` of rows (uid, doc_id, text) whose ids repeat in every scan."""
    signed = scratch.put(docs.mapInArrow(sign, "uid long, doc_id long, digest binary, shingles long, bands array<long>"), "signatures")
    folded = signed.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    folded = scratch.put(folded, "folded")
    reps = scratch.put(signed.select("uid", "shingles", "bands").join(folded.select("uid", "copies"), "uid"), "representatives")
    tasks = scratch.put(groups(reps, scratch, group_rows, group_shingles), "groups")
    shared = ~F.col("alone")
    n, few, total = tasks.join(reps.select("uid", "shingles"), "uid").agg(F.count("*"), F.count_if(shared), F.coalesce(F.sum(F.when(shared, F.col("shingles"))), F.lit(0))).first()
    # Groups that are whole share packs; a pair of blocks fills one by itself.
    packs = max(1, few // group_rows, total // group_shingles)
    wanted = tasks.select("uid").distinct()
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = docs.select("uid", "text").join(wanted, "uid").mapInArrow(shingled, "uid long, set binary")
    rows = sets.join(reps, "uid").join(tasks, "uid").withColumn("pack", F.when(F.col("alone"), F.xxhash64("gid", "i", "j", "band")).otherwise(F.pmod(F.xxhash64("gid", "i", "j", "band"), F.lit(packs))))
    found = rows.groupBy("pack").applyInArrow(verify, "uid long, links long, root long")
    found = scratch.put(found, "links")
    scratch.drop("groups", "representatives")
    classes = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    per = folded.join(links, "uid", "left").join(classes.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    per = scratch.put(per, "classes")
    least = per.groupBy("root").agg(F.min("least").alias("class_id"))
    per = per.join(least, "root").select("digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("uid", "doc_id", "digest")
    # Rows without words stay out of the join, where they would share one key.
    bare = out.where("digest is null").select("uid", F.col("uid").alias("root"), "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.where("digest is not null").join(per, "digest").select("uid", "root", "doc_id", "class_id", "n_links").unionByName(bare)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, of which each set of linked rows keeps one: that of the least id (of rows that share it, the first read)."""
    scratch, columns = c.Scratch(documents.sparkSession), documents.columns
    (row,) = c.fresh(columns, "__row")
    rows = c.identified(documents, scratch, row)
    found = joined(rows.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    # Rows without links stay; of the others, each component keeps its least row by (id, place). Its class id may be null or another's too.
    linked = scratch.put(found.where("n_links > 0").select("uid", "root", "doc_id"), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "uid"))["uid"].alias("uid")).select("uid")
    gone = linked.select("uid").join(first, "uid", "left_anti")
    side = F.broadcast(gone) if linked.count() <= BROADCAST_ROWS else gone
    return rows.join(side, rows[row] == side["uid"], "left_anti").select(columns)


def op1_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid", "root")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT x.a, x.b FROM (SELECT p.r AS a, q.r AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.r <> q.r GROUP BY ALL) x JOIN n na ON na.r = x.a JOIN n nb ON nb.r = x.b WHERE 9 * x.k >= 4 * (na.n + nb.n)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1),
many AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
SELECT d.doc_id, class.class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d JOIN class USING (r) LEFT JOIN many USING (r)
"""
