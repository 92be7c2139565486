"""The pipeline on a small folder of tables: every stage takes effect and clean documents stay."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    clean = [(i, text(rng, 60)) for i in range(80)]
    bad = [(200 + i, "!! ".join(text(rng, 40).upper().split())) for i in range(40)]
    copies = [(300 + i, clean[i][1]) for i in range(10)]
    leak = "seven unusual benchmark words that nobody else would write here at all"
    leaked = [(400, text(rng, 30) + " " + leak + " " + text(rng, 30))]
    rows = [(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(clean + bad + copies + leaked)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in clean + bad], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).persist()
        assert docs.columns[:5] == columns and (k == 4 or docs.columns == columns)
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert sum(i < 200 for i in seen[0]) >= 78 and sum(200 <= i < 240 for i in seen[0]) <= 2
    assert not any(300 <= i < 310 for i in seen[1]) and len(seen[1]) == len(set(seen[1]))
    assert 400 not in seen[2] and set(seen[2]) == set(seen[1]) - {400}
    assert max(seen[3].count(i) for i in seen[3]) <= 3 and sorted(seen[4]) == sorted(seen[3])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"shard", "n_bytes", "shard_bytes"} <= set(out.columns)
