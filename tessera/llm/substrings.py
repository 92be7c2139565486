"""Removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash of WINDOW bytes triggers phrase ends: a place is a trigger if it
is the least (and leftmost) of the hashes inside some string of LENGTH bytes,
so every such string holds a trigger that its own bytes alone decide, and equal
strings hold it at the same offset. The strings that share one trigger place
form a phrase: the bytes from the first of them to the end of the last.

Parse: all phrases, dealt by the trigger's hash and sorted by (trigger, phrase,
corpus order), in narrow rows without text. In that order, which is the suffix
order of the parse up to LENGTH bytes, every phrase but the first of its kind
consists of repeats only. Dictionary: first phrases that share a trigger with
another first phrase may have some of their strings in common; those strings
(suffixes of dictionary phrases, cut at LENGTH bytes) are hashed, sorted in the
same way, and all but the first of each are repeats. Both sorts stream through
their partitions with the state of one row, so no group of copies, however
large, is held in memory, and no pair is formed.

Both orders are orders of hashes, not of bytes: only equality matters here, so
the suffix arrays of dictionary and parse are replaced by sorts of fixed-width
keys, which Spark deals and spills. Equality is that of 128 bits: of two hashes
of the trigger and of the phrase, or of two hashes of the string.

Defined results: null and empty texts have no bytes, no spans and the hash of
nothing; texts under LENGTH bytes keep all; rows that repeat an id count in the
order in which the table is read; rows with a null id come last; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as c

LENGTH = 100
WINDOW = 32
#: Positions that are hashed at a time.
BLOCK = 1 << 18
#: Bytes of sorted rows in a partition, about, and partitions at most.
PARTITION_BYTES = 128 << 20
MOST_PARTITIONS = 100_000
_PLACE = np.uint64(24)


def triggers(data: np.ndarray, length: int, window: int):
    """Of one document: trigger, first and last start of the strings of each phrase, and the hashes of trigger and phrase.

    In blocks of starts; a phrase that a block's edge cuts is joined again.
    """
    n = len(data) - length + 1
    reach = length - window + 1  # rolling hashes inside one string
    out = []
    for base in range(0, n, BLOCK):
        m = min(BLOCK, n - base)
        part = data[base : base + m + length - 1]
        h = c.prefix_hash(part)
        inverse = c.powers(len(part) + 1)[1]
        rolled = c.mix((h[window:] - h[:-window]) * inverse[: len(h) - window])
        # Hash in the high bits, place in the low: the least is the least hash, leftmost.
        key = (rolled >> _PLACE << _PLACE) | np.arange(len(rolled), dtype=np.uint64)
        least, span = key, 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        at = (least[:m] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [m - 1]])
        out.append((at[first] + base, first + base, last + base, rolled[at[first]]))
    trigger, first, last, key = (np.concatenate(x) for x in zip(*out, strict=True))
    # A phrase cut by a block's edge goes on in the next block with the same trigger.
    keep = np.concatenate([[True], trigger[1:] != trigger[:-1]])
    begin = np.flatnonzero(keep)
    return trigger[begin], first[begin], last[np.concatenate([begin[1:], [len(trigger)]]) - 1], key[begin]


def parse(length: int, window: int):
    """Rows (trigger hash, phrase hash, order, uid, first, last) of all phrases. A phrase's hash covers its bytes and where its trigger stands."""

    def run(batches):
        for batch in c.pieces(batches, most=1 << 22):
            data, offsets = c.text_bytes(batch.column("text"))
            # Runs of documents are handled as one text, where strings across a boundary are then left out.
            sizes = np.diff(offsets)
            if not (sizes >= length).any():
                continue
            first, last, key, whole = blockwise(data, offsets)
            doc = np.searchsorted(offsets, first, "right") - 1
            place, uid = (batch.column(k).to_numpy()[doc] for k in ("place", "uid"))
            # Phrases that this block holds before are repeats for certain: they need not meet the others of their
            # trigger, so they are merged into runs, marked by a negative length and dealt by a hash of their place.
            order = np.lexsort((first, uid, place, whole, key))
            again = np.zeros(len(first), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            begin = np.flatnonzero(np.concatenate([[True], ~(again[1:] & again[:-1] & (doc[1:] == doc[:-1]))]))
            last = last[np.concatenate([begin[1:], [len(first)]]) - 1]
            first, doc, place, uid, key, whole, again = (x[begin] for x in (first, doc, place, uid, key, whole, again))
            key = np.where(again, c.mix(uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)), key)
            more = np.where(again, -1 - (last - first), last - first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(place), pa.array(uid), pa.array(first - offsets[doc]), pa.array(more)],
                ["trigger", "phrase", "place", "uid", "first", "more"],
            )

    def blockwise(data, offsets):
        trigger, first, last, key = triggers(data, length, window)
        # Strings that start in the last length - 1 bytes of a document run into the next one: cut phrases there.
        good = np.ones(len(data) - length + 1, bool)
        for e in offsets[1:]:
            good[max(0, e - length + 1) : e] = False
        # Of each phrase, runs of good starts (documents shorter than the string leave none).
        starts = np.zeros(len(good), np.int64)
        starts[first] = 1
        phrase = np.cumsum(starts) - 1
        edge = np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (good[1:] != good[:-1])])
        begin = np.flatnonzero(edge & good)
        ends = np.flatnonzero(np.concatenate([edge[1:], [True]]) & good)
        p = phrase[begin]
        whole = c.hash_spans(data, begin, ends + length, lowered=False)
        whole = c.mix(whole + (trigger[p] - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (ends - begin).astype(np.uint64))
        return begin, ends, key[p], whole

    return run


def judge(batches):
    """Phrases sorted by (trigger, phrase, place, uid, first): repeats (kind 0), and first phrases beside others of their trigger (kind 1).

    A first phrase is held back until the next first phrase shows whether it is alone.
    """
    pending: dict = {}

    def rows(kind, uid, place, first, more):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), kind, np.int8)), pa.array(uid), pa.array(place), pa.array(first), pa.array(more)], ["kind", "uid", "place", "first", "more"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, p, place, uid, first, more = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("trigger", "phrase", "place", "uid", "first", "more"))
        known = more < 0
        if known.any():
            yield rows(0, uid[known], place[known], first[known], -1 - more[known])
            t, p, place, uid, first, more = (x[~known] for x in (t, p, place, uid, first, more))
            if not len(t):
                continue
        before_t = np.concatenate([[last[0] if last else t[0]], t[:-1]])
        before_p = np.concatenate([[last[1] if last else p[0]], p[:-1]])
        new = (t != before_t) | (p != before_p)
        if last is None:
            new[0] = True
        if not new.all():
            yield rows(0, uid[~new], place[~new], first[~new], more[~new])
        at = np.flatnonzero(new)
        if len(at):
            heads = {"t": t[at], "uid": uid[at], "place": place[at], "first": first[at], "more": more[at], "shared": np.zeros(len(at), bool)}
            if pending:
                heads = {k: np.concatenate([pending[k], v]) for k, v in heads.items()}
            same = heads["t"][1:] == heads["t"][:-1]
            heads["shared"][1:] |= same
            heads["shared"][:-1] |= same
            pending = {k: v[-1:] for k, v in heads.items()}
            out = heads["shared"][:-1]
            if out.any():
                yield rows(1, *(heads[k][:-1][out] for k in ("uid", "place", "first", "more")))
        last = (t[-1], p[-1])
    if pending and pending["shared"][0]:
        yield rows(1, *(pending[k] for k in ("uid", "place", "first", "more")))


def suffixes(length: int):
    """Hashes of all strings of the phrases in ``edges`` (first start, further starts)."""

    def run(batches):
        for batch in c.pieces(batches, most=1 << 22):
            data, offsets = c.text_bytes(batch.column("text"))
            lists = batch.column("edges").combine_chunks() if isinstance(batch.column("edges"), pa.ChunkedArray) else batch.column("edges")
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            first, more = flat.field("first").to_numpy(), flat.field("more").to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), count)
            doc, start = np.repeat(doc, more + 1), np.repeat(first + offsets[doc], more + 1)
            start = start + np.arange(len(start)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            order = np.argsort(start, kind="stable")
            doc, start = doc[order], start[order]
            for k in range(0, len(start), 1 << 18):
                own, d = start[k : k + (1 << 18)], doc[k : k + (1 << 18)]
                h, again = (c.hash_spans(data, own, own + length, lowered=False, second=x) for x in (False, True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(again.view(np.int64)), batch.column("place").take(pa.array(d)), batch.column("uid").take(pa.array(d)), pa.array(own - offsets[d])], ["string", "second", "place", "uid", "first"])
        c.release()

    return run


def repeats(batches):
    """Strings sorted by (string, second, place, uid, first): all but the first of each."""
    last = None
    for batch in batches:
        if batch.num_rows:
            h, more = batch.column("string").to_numpy(), batch.column("second").to_numpy()
            again = np.concatenate([[last == (h[0], more[0])], (h[1:] == h[:-1]) & (more[1:] == more[:-1])])
            last = h[-1], more[-1]
            keep = pa.array(again)
            yield pa.RecordBatch.from_arrays([batch.column("uid").filter(keep), batch.column("first").filter(keep), pa.array(np.zeros(int(again.sum()), np.int32))], ["uid", "first", "more"])


def finish(length: int, text: bool):
    """Merges the runs of repeats of each document and takes their bytes out."""

    def run(batches):
        for batch in c.pieces(batches):
            data, offsets = c.text_bytes(batch.column("text"))
            runs = batch.column("runs").to_pylist()
            n_removed, n_spans, digest, spans, rest = [], [], [], [], []
            for i, own in enumerate(runs):
                doc = data[offsets[i] : offsets[i + 1]]
                cut: list[list[int]] = []
                for s, e in sorted((r["first"], r["first"] + r["more"] + length) for r in own or ()):
                    if cut and s <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], e)
                    else:
                        cut.append([s, e])
                kept = bytearray()
                at = 0
                for s, e in cut:
                    kept += doc[at:s].tobytes()
                    at = e
                kept += doc[at:].tobytes()
                n_removed.append(len(doc) - len(kept))
                n_spans.append(len(cut))
                digest.append(hashlib.sha256(kept).hexdigest())
                if text:
                    spans.append([{"start": s, "end": e} for s, e in cut])
                    rest.append(bytes(kept).decode("utf-8", "ignore"))
            more = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.string())] if text else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), *more],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if text else [])],
            )

    return run


def deduplicate(documents: DataFrame, length: int = LENGTH, window: int = WINDOW, text: bool = False) -> DataFrame:
    """One row per document row; with ``text`` also the removed spans and what is left (bytes of cut characters dropped)."""
    spark, scratch = documents.sparkSession, c.Scratch(documents.sparkSession)
    docs = c.identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch)
    place = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place")
    # Sorted rows are about three times the size of the files; partitions follow it.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(MOST_PARTITIONS, max(c.partitions(spark), -(-3 * size // PARTITION_BYTES)))
    phrases = docs.select("uid", place, "text").where(F.octet_length("text") >= length).mapInArrow(parse(length, window), "trigger long, phrase long, place long, uid long, first long, more int")
    judged = phrases.repartition(n, "trigger").sortWithinPartitions("trigger", "phrase", "place", "uid", "first").mapInArrow(judge, "kind byte, uid long, place long, first long, more int")
    judged = scratch.put(judged, "phrases")
    edges = judged.where("kind = 1").groupBy("uid").agg(F.collect_list(F.struct("first", "more")).alias("edges"))
    # The same rows and columns as in the last join, so that the texts are shuffled once for both.
    strings = docs.join(edges, "uid").select("uid", place, "text", "edges").mapInArrow(suffixes(length), "string long, second long, place long, uid long, first long")
    shared = strings.repartition(n, "string").sortWithinPartitions("string", "second", "place", "uid", "first").mapInArrow(repeats, "uid long, first long, more int")
    runs = judged.where("kind = 0").select("uid", "first", "more").unionByName(shared).groupBy("uid").agg(F.collect_list(F.struct("first", "more")).alias("runs"))
    more = ", spans array<struct<start:long,end:long>>, kept string" if text else ""
    return docs.join(runs, "uid", "left").mapInArrow(finish(length, text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
