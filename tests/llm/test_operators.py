"""Corpus operators against brute force on small tables with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import _core as c
from tessera.llm import decontamination, licenses, linkgraph, mixing, quality, scoring, sharding, similarity, substrings, topk
from tessera.llm._graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, __key string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix étrange potions in großen kettles near old rivers".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [text(rng, rng.randrange(20, 120)) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i]) for i in range(6)]  # copies
    out += [(200 + i, base[i].replace("fox", "vixen", 1)) for i in range(12)]  # near copies
    out += [(300 + i, text(rng, 10) + " " + base[7][:180] + " " + text(rng, 9)) for i in range(5)]  # a shared passage
    out += [(400, None), (401, ""), (402, "   \n"), (403, "one two"), (404, "one two"), (405, "ab " * 900), (None, base[2]), (None, None), (5, base[5]), (5, base[5]), (406, "é" * 130), (407, "x" * 5000)]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 4}", len(t or ""), k % 3, "k") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def lowered(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


def rank(x):
    return tuple((v is None, v) for v in x)


def test_similarity_matches_all_pairs(docs, rows):
    sets = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := alnum(r[1])) else set()) for r in rows]
    linked = lambda a, b: a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))
    n = len(rows)
    links = [[j for j in range(n) if j != i and linked(sets[i], sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    least = {}
    for i in range(n):
        least.setdefault(root[i], []).append(rows[i][0])
    want = sorted(((rows[i][0], min((x for x in least[root[i]] if x is not None), default=None), len(links[i])) for i in range(n)), key=rank)
    for sizes in ((1024, 1 << 21), (3, 1 << 21), (1024, 200)):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in similarity.join(docs, *sizes).collect()), key=rank)
        assert got == want


def test_one_of_each_class_stays(docs, rows):
    kept = similarity.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 100 not in ids and 200 not in ids and 400 in ids and 401 in ids


def test_one_of_each_tells_classes_of_one_id_apart(spark):
    rng = random.Random(11)
    a, b, d, e = (text(rng, 40) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (None, b), (None, b), (1, d), (2, d), (1, e), (3, e), (4, text(rng, 40)), (None, text(rng, 40))]
    kept = similarity.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=rank) == sorted({(None, a), (None, b), (1, d), (1, e), *rows[9:]}, key=rank)


def test_banding_reaches_its_recall():
    b, r = similarity.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 160
    with pytest.raises(ValueError):
        similarity.bands_for(0.1, 0.999999, 10)


def test_topk_matches_brute_force(spark):
    rng = random.Random(5)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    vecs += [(0, vecs[0][1]), (500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (505, [0.5] * 3), (520, [0.25] * 3), (540, [1e7] * 6), (541, [1e7] * 6), (560, [5e7, 1.0]), (580, [1.0, 1.0]), (561, [2.0, 2.0]), (562, [4e7, 0.0]), (563, [-3e9, -0.01])]
    vecs += [(600 + i, vecs[20][1]) for i in range(30)]  # ties
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, dim int").repartition(4)
    got = topk.search(df, F.col("vec_id") % 20 == 0, 7, shard_rows=90, block_rows=8).collect()
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:7]
        want += [(i, k, j, max(topk.NONE, -s)) for k, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("limit", [300, 2000, 10**9])
def test_shards_fit_and_hold_all(docs, rows, limit):
    out = sharding.assign(docs, limit).collect()
    assert sorted((tuple(r.row) for r in out), key=rank) == sorted(rows, key=rank)
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(len((r.row.text or "").encode()))
        assert r.n_bytes == len((r.row.text or "").encode())
    for r in out:
        assert r.shard_bytes == sum(held[r.shard])
    assert all(sum(x) <= limit or len([y for y in x if y]) == 1 for x in held.values())


def test_shards_of_one_hot_id(spark):
    for hot in (1, None):
        df = spark.createDataFrame([(hot, "x" * 50)] * 600 + [(2, "y" * 10)], "doc_id long, text string")
        out = sharding.assign(df, 400).groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.max("shard_bytes").alias("m"), F.count("*").alias("rows")).collect()
        assert all(r.n == r.m and r.n <= 400 for r in out) and len(out) > 75 and sum(r.rows for r in out) == 601


def test_mix_meets_targets(docs, rows):
    narrow = mixing.narrowed(docs)
    out = mixing.take(narrow).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    names = sorted((x for x in per if x is not None)) + [None]
    weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(names)}
    total, capped = sum(per.values()), set()
    while True:
        free = [x for x in names if x not in capped]
        level = (total - sum(3 * per[x] for x in capped)) / sum(weight[x] for x in free)
        over = {x for x in free if level * weight[x] > 3 * per[x]}
        if not over:
            break
        capped |= over
    want = {x: 3 * per[x] if x in capped else level * weight[x] for x in names}
    taken = Counter()
    for r in out:
        assert abs(r["__target"] - want[r["__source"]]) < 1e-6 and 0 <= r["__taken"] <= 3 * r["__size"]
        taken[r["__source"]] += r["__taken"]
    assert all(taken[x] == math.floor(want[x] + 1e-9) for x in names)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += size(r.text)
    assert all(abs(got[x] - want[x]) <= max(size(r[1]) for r in rows) for x in names)


def test_license_places(docs, spark):
    extra = spark.createDataFrame([(900, "Under the MIT License, under the mit license. cc-by nc"), (901, "APACHE license, version 2.0"), (902, "This program is free software you can redistribute it and or modify it under the terms of the new GNU General Public License as published by the Free Software Foundation")], "doc_id long, text string")
    s = {r.doc_id: r for r in licenses.scan(extra.unionByName(docs.select("doc_id", "text"))).collect()}
    base = lambda k: [(x.label, x.first_word) for x in s[k].spans if x.base]
    assert sorted(base(900)) == [("cc-by-nc", 8), ("mit", 0), ("mit", 4)] and base(901) == [("apache-2", 0)]
    assert any(x.label == "gpl" for x in s[902].spans) and not s[403].spans and s[400].n_words == 0 and s[400].score == 0


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_substrings_match_brute_force(docs, monkeypatch, block, spark):
    monkeypatch.setattr(substrings, "BLOCK", block)
    own = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1)
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, r.text) for r in own.collect()):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, c in zip(b, cut) if not c)
        want[i] = (len(b), sum(cut), sum(cut[k] and not (k and cut[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(own).collect()}
    assert got == want


def test_one_of_each_of_a_plan_that_is_no_scan(spark, docs):
    plan = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = {frozenset((r.doc_id, r.text) for r in similarity.one_of_each(x).collect()) for x in (plan, plan.repartition(5), plan.coalesce(1))}
    assert len(kept) == 1


CLASH = ["__row", "__key", "__name", "__uid", "__h", "__score", "shard", "n_bytes", "row", "uid", "h"]


def test_clashing_columns_keep_their_values(spark, docs):
    wide = docs.select("doc_id", "text", "lang", "source", *(F.concat(F.lit(f"{x}:"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(x) for x in CLASH))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for out in (similarity.one_of_each(wide), mixing.mix(wide), decontamination.clean(wide, items(spark, docs)), sharding.assign(wide).select("row.*"), quality.score(wide, quality.train(wide, labels), wide.columns, c.fresh(wide.columns, "__score")[0]).select(wide.columns)):
        found = out.collect()
        assert found and out.columns == wide.columns
        assert all(r[x] == f"{x}:{-1 if r.doc_id is None else r.doc_id}" for r in found for x in CLASH)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = text(rng, 130_000)  # longer than the pieces and segments in which texts are handled
    assert len(long.encode()) > c.SEGMENT
    rows = [(1, long), (2, long + " the end"), (3, "short text of few words only"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in similarity.join(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    bench = spark.createDataFrame([(1, " ".join(alnum(long)[-9:]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.search(df, bench).collect()}
    assert found[1].spans[-1].start == len(alnum(long)) - 9 and found[1].n_words == len(alnum(long)) and not found[3]["items"]
    cut = {r.doc_id: r.n_removed for r in substrings.deduplicate(df).collect()}
    assert cut[2] >= len(long.encode()) and cut[3] == cut[4] == 0
    assert all(r.score < 0 for r in scoring.score(df).collect())


def test_factorisation_machine_equals_all_pairs():
    import numpy as np

    texts = c.pa.array(["one two three two", "", "UPPER words, and more: words!"])
    d, s, value, stats = quality.featurise(texts)
    machine = quality.Machine(np.stack([np.quantile(stats[:, j], np.arange(1, quality.BINS) / quality.BINS) for j in range(stats.shape[1])]))
    machine.w = np.random.default_rng(1).normal(size=quality.SLOTS).astype(np.float32)
    docs, slots, values = machine.design(d, s, value, stats)
    z, _ = machine.raw(docs, slots, values, 3)
    for k in range(3):
        own = [(int(i), float(x)) for i, x, q in zip(slots, values, docs) if q == k]
        want = machine.b + sum(float(machine.w[i]) * x for i, x in own)
        want += sum(float(machine.v[own[a][0]] @ machine.v[own[b][0]]) * own[a][1] * own[b][1] for a in range(len(own)) for b in range(a))
        assert z[k] == pytest.approx(want, abs=1e-4)


def test_substrings_of_repeated_rows(spark):
    t = "".join(map(str, range(80)))
    out = substrings.deduplicate(spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string"), text=True).collect()
    assert sorted(r.n_removed for r in out) == [0, len(t), len(t)] and [r.n_removed for r in out if r.doc_id is None] == [len(t)]


def test_quality_learns_form(spark):
    rng = random.Random(1)
    good = [(i, text(rng, rng.randrange(20, 60))) for i in range(160)]
    bad = [(1000 + i, "!! ".join(text(rng, 30).upper().split())) for i in range(80)]
    d = spark.createDataFrame([(i, t, 0.0) for i, t in good + bad] + [(None, None, 0.0), (5000, "", 0.0)], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    s = quality.score(d, quality.train(d, labels), ["doc_id"]).collect()
    held = [(r.doc_id, r["__score"]) for r in s if r.doc_id is not None and r.doc_id != 5000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((x >= 0.7) == (i < 1000) for i, x in held) / len(held) > 0.95
    assert all(0 <= r["__score"] <= 1 for r in s) and len(s) == 242
    none = quality.score(d, quality.train(d, labels.where("false")), ["doc_id", "text"])
    assert {r["__score"] for r in none.collect()} == {0.5}


def items(spark, docs):
    b = [r.text for r in docs.where("doc_id IN (3, 8)").select("text").collect()]
    return spark.createDataFrame([(1, " ".join(b[0].split()[4:16])), (2, "one TWO"), (2, "quick"), (3, ""), (None, "the quick"), (4, None), (10, " ".join(b[1].split()[2:11]).upper())], "item_id long, text string")


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, docs, rows, chunk):
    bench = items(spark, docs)
    wins = [(str(r.item_id), w[k : k + 8]) for r in bench.collect() if r.item_id is not None and (w := alnum(r.text)) for k in range(max(1, len(w) - 7))]
    want = []
    for i, t, *_ in rows:
        w, hit, found = alnum(t), set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    got = [tuple(r)[:6] for r in decontamination.digest(decontamination.search(docs, bench, chunk_bytes=chunk)).collect()]
    assert sorted(got, key=rank) == sorted(want, key=rank)
    kept = decontamination.clean(docs, bench, most=0, chunk_bytes=chunk)
    assert kept.columns == docs.columns and kept.count() == sum(x[3] == 0 for x in want)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha delta")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    near = {r.doc_id: (r["items"], r.near_items) for r in decontamination.search(d, b, slop=1).collect()}
    assert near == {1: ([], ["i"]), 2: (["i"], []), 3: ([], [])}


def test_rules_and_link_graph(spark):
    page = lambda k, u, *links: (k, u, "".join(f'<a href="http://{x}/p">x</a>' for x in links))
    rows = [
        page(1, "http://a.com/x"), page(2, "HTTP://Www.Example.COM/en/1?q#f"), page(3, "http://m.example.com/en/2"), page(4, "http://z.net/es/1"), page(5, "http://hub.org/1", "z.net"), page(6, "http://good.org/1"), page(7, "http://a.com/", "good.org"), page(8, None), page(9, "nothing"), page(10, "http://b.com"), page(11, "http://z.net/de/1"), (12, "http://q.org/#x", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow") and got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][2:] == ("example.com/en/", "block") and got[4][2:] == ("net/es/", "block")
    assert got[6] == ("good.org", "/1", None, "allow") and got[8] == ("", "", None, "allow") == got[9] and got[10][:3] == ("b.com", "", None)
    ranks = {r.page_id: (r.trust, r.distrust) for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert ranks[6][0] > 0 and ranks[5][1] > 0 and ranks[12] == (0, 0)


def test_ranks_match_plain_pagerank(spark):
    """Cycles, hosts without links, a chain of more than 12 hops and repeated links, against power iteration."""
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("b", "d", 3), ("e", "d", 1), ("f", "e", 1), ("x", "d", 1), *((f"n{k:02}", f"n{k + 1:02}", 1) for k in range(20))]
    seeds = {"a": (1.0, 0.0), "d": (0.0, 1.0), "n00": (0.5, 0.0), "n20": (0.0, 1.0)}
    hosts = sorted({x for e in edges for x in e[:2]})
    want = {}
    for kind in (0, 1):
        rank = {h: 0.0 for h in hosts}
        for _ in range(400):
            new = {h: (1 - linkgraph.DAMPING) * seeds.get(h, (0, 0))[kind] for h in hosts}
            for a, b, n in edges:
                src, dst = (a, b) if kind == 0 else (b, a)
                out = sum(m for x, y, m in edges if (x if kind == 0 else y) == src)
                new[dst] += linkgraph.DAMPING * rank[src] * n / out
            rank = new
        want[kind] = rank
    s = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double")
    found = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(s, spark.createDataFrame(edges, "src string, dst string, n long"), c.Scratch(spark), tolerance=1e-9).collect()}
    assert all(found.get(h, (0, 0))[k] == pytest.approx(want[k][h], abs=1e-7) for h in hosts for k in (0, 1))
    assert found["n19"][0] > 0 and found["f"][1] > 0


def test_links_to_blocked_hosts_change_a_verdict(spark):
    rules = (("block", "bad.net", "/"), ("allow", "good.com", "/"))
    page = lambda k, host, *links: (k, f"http://{host}/p", "".join(f'<a href="http://{x}/">x</a>' for x in links))
    rows = [page(1, "bad.net"), page(2, "one.org", "bad.net"), page(3, "two.org", "bad.net"), page(4, "far.org", "one.org"), page(5, "good.com", "fine.org"), page(6, "fine.org"), page(7, "lone.org")]
    got = {r.host: r.verdict for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {"bad.net": "block", "one.org": "block", "two.org": "block", "far.org": "block", "good.com": "allow", "fine.org": "allow", "lone.org": "allow"}


def test_scores_match_unigrams_and_form_a_distribution(spark, docs, rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), None] for _, t, *_ in rows]
    n = Counter()
    for (i, *_), w in zip(rows, tokens):
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            n.update(w)
    total = sum(n.values())
    want = sorted((round(sum(math.log10((n[x] + 0.5) / (total + 0.5 * (len(n) + 1))) for x in w), 6), len(w), sum(n[x] > 0 for x in w)) for w in tokens)
    for heavy in (1 << 19, 5):
        got = scoring.score(docs, heavy).collect()
        assert sorted((round(r.base_score, 6), r.n_tokens, r.n_known) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 for r in got)
    # Whatever was learnt, the ways of each decision share one unit of probability.
    model = scoring.train_model(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    p = 2.0 ** -model.cost.astype(float)
    assert abs(p.sum(axis=1) - 1).max() < 1e-5


def test_scores_mix_memory_and_bits(spark, docs, rows):
    """Each text alone, with plain counts and loops, gives what blocks, broadcasts and joins give."""
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    model = scoring.train_model(own.where((c.fold(F.col("doc_id"), scoring.FOLDS) != scoring.HELD_OUT)))
    learnt = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    parts = []
    for i, t, *_ in rows:
        column = c.pa.array([t], c.pa.string())
        begin, end, key, _ = scoring.phrases(*c.text_bytes(column))
        running = model.bits(column)
        bits = [running[e + (k + 1 == len(end))] - running[b] for k, (b, e) in enumerate(zip(begin, end))]
        parts.append((i, key.tolist(), bits))
    count = Counter(x for i, keys, _ in parts if learnt(i) for x in keys)
    total = sum(count.values())
    want = []
    for i, keys, bits in parts:
        mine = Counter(keys) if learnt(i) else Counter()
        by_rate = [sum(math.log2(rate * (count[k] - mine[k]) / total + (1 - rate) * 2.0**-b) if b < 1000 else math.log2(1 - rate) - b for k, b in zip(keys, bits)) for rate in scoring.RATES]
        top = max(by_rate)
        want.append((top + math.log2(sum(2.0 ** (x - top) for x in by_rate) / len(by_rate))) * math.log10(2))
    for heavy in (1 << 19, 0):
        got = [r.score for r in scoring.score(docs, heavy).collect()]
        assert sorted(got) == pytest.approx(sorted(want), rel=1e-4, abs=1e-3)
    # Whatever holds the rows.
    assert sorted(got) == pytest.approx(sorted(r.score for r in scoring.score(docs.repartition(7)).collect()), abs=1e-4)


@pytest.mark.parametrize("ids", [range(1, 2), range(40)])
def test_all_training_rows_teach_the_weights(spark, ids):
    rng = random.Random(4)
    train = [(i, text(rng, 30)) for i in ids]
    model = scoring.train_model(spark.createDataFrame(train, "doc_id long, text string"))
    coded = [b for _, t in train for b in (*t.encode(), scoring.END)]
    assert model.seen.sum() == sum(int(model.tree.length[b]) for b in coded)


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    b = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert similarity.join(d).count() == 0 and sharding.assign(d).count() == 0 and mixing.mix(d).count() == 0 and licenses.scan(d).count() == 0
    assert substrings.deduplicate(d).count() == 0 and quality.score(d, quality.train(d, labels), ["doc_id"]).count() == 0
    assert decontamination.search(d, b).count() == 0 and scoring.score(d).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert linkgraph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components_of_hubs_chains_and_random_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 1500)] + [(9000, 9000 - i) for i in range(1, 1500)] + [(2600 + i * 37 % 900, 2600 + i * 101 % 900) for i in range(600)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), c.Scratch(spark)).collect()
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), c.Scratch(spark)).count() == 0
