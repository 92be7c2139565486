"""License scans by diagonal voting.

Every rolling K-word gram of a document whose hash occurs in some template
(a filter of a few hundred hashes, pushed into the scan) goes to a Spark join
with the templates' positions, on the hash and on the gram's own words, so
votes are exact. Votes are summed by offset diagonal (place in the document
less place in the template). A base phrase stands wherever one diagonal has all
of its grams. For longer templates, diagonals at most GAP apart are merged, as
insertions and deletions shift them; a merged group whose grams cover at least
COVERAGE of the template, within a span of at most SPREAD times its words, is a
verified span and adds the template's label.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are documents of their own; texts shorter than K words have no
grams; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _core as c

K = 3
GAP = 4
COVERAGE = 0.6
SPREAD = 2.0

# Phrases and labels of the base result.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening or notice sentences of public licenses.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
]


def words_of(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def positions(k: int = K) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, base, grams, words, place, gram) for all grams of all templates."""
    out = []
    for i, (label, text, base) in enumerate([*((b, a, True) for a, b in PHRASES.items()), *((a, b, False) for a, b in TEMPLATES)]):
        own = words_of(text)
        out += [(i, label, base, len(own) - k + 1, len(own), at, " ".join(own[at : at + k])) for at in range(len(own) - k + 1)]
    return out


def gram_hashes(texts: list[str], k: int) -> np.ndarray:
    """Hash of each text's first k words."""
    data, offsets = c.text_bytes(pa.array(texts))
    starts, ends, first = c.find_words(data, offsets, c.ALNUM)
    g = c.grams(c.hash_spans(data, starts, ends), k)
    return g[first[:-1]]


def scanner(known: np.ndarray, k: int):
    def run(batches):
        for batch in c.pieces(batches):
            n = batch.num_rows
            data, offsets = c.text_bytes(batch.column("text"))
            starts, ends, first = c.find_words(data, offsets, c.ALNUM)
            g = c.grams(c.hash_spans(data, starts, ends), k)
            doc = np.repeat(np.arange(n), np.diff(first))
            slot = np.minimum(np.searchsorted(known, g), len(known) - 1)
            at = np.flatnonzero((known[slot] == g) & (doc[: len(g)] == doc[k - 1 :][: len(g)]))
            lowered = [" ".join(c.decode(data, starts[i + j], ends[i + j]) for j in range(k)) for i in at.tolist()]
            null = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("uid"), batch.column("uid").take(pa.array(doc[at]))]), pa.concat_arrays([batch.column("doc_id"), null]), pa.concat_arrays([pa.array(np.diff(first), pa.int64()), null]), pa.array(np.concatenate([np.full(n, -1), at - first[doc[at]]])), pa.array([*[None] * n, *lowered], pa.string()), pa.array([*[None] * n, *g[at].view(np.int64).tolist()], pa.int64())],
                ["uid", "doc_id", "n_words", "pos", "gram", "hash"],
            )

    return run


def scan(documents: DataFrame, k: int = K) -> DataFrame:
    """One row per document row: n_words, spans (label, base, first word, words, coverage)."""
    spark = documents.sparkSession
    rows = positions(k)
    hashes = gram_hashes([r[-1] for r in rows], k)
    templates = spark.createDataFrame([(*r, int(h)) for r, h in zip(rows, hashes.view(np.int64), strict=True)], "template int, label string, base boolean, grams int, size int, tpos int, tgram string, thash long")
    docs = c.identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), c.Scratch(spark))
    found = docs.mapInArrow(scanner(np.unique(hashes), k), "uid long, doc_id long, n_words long, pos long, gram string, hash long")
    # The templates are a constant of this module: a few hundred rows.
    votes = found.join(F.broadcast(templates), (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram")), "left").repartition("uid")
    diagonals = votes.groupBy("uid", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.first("size").alias("size"), F.count("tpos").alias("votes"), F.collect_set("tpos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    w = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(w) > GAP), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(w)).groupBy("uid", "template", "cluster").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.first("size").alias("size"), F.min("diagonal").alias("diagonal"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    coverage = F.col("covered") / F.col("grams")
    good = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise((coverage >= COVERAGE) & (F.col("high") + k - F.col("low") <= SPREAD * F.col("size")))
    span = F.when(good, F.struct("label", "base", F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("low")).alias("first_word"), (F.col("high") + k - F.col("low")).alias("words"), coverage.alias("coverage")))
    return merged.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"), F.coalesce(F.max(coverage), F.lit(0.0)).alias("score"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["base"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    place = F.transform(base, lambda x: x["first_word"])
    return s.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"), named(base).alias("base_labels"), named(F.col("spans")).alias("labels"), "score")
