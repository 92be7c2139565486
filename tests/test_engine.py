"""Contracts, compiler, folds, metrics, search, ledger, retrieval, command line and streams."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.contracts import ContractError, Dataset, Feature, Hypothesis, Proposal, check_params
from tessera.operators import evidence, folds, metrics, prep
from tessera.plans.compiler import FeatureModel, fit
from tessera.plans.graph import Graph
from tessera.search.samplers import AutonomousSampler, Client, Context, EvolutionSampler, HybridSampler, ModelSampler, RandomSampler, prompt, strict_json
from tessera.search.study import Budget, Study
from tessera.sources.artifacts import Artifacts
from tessera.sources.ledger import Ledger, LedgerLocked


def field(name, dtype="numeric", **more):
    return {"name": name, "dtype": dtype, "description": name, **more}


PARCELS = {"fields": [field("weight"), field("price"), field("zone", "categorical")]}


@pytest.fixture(scope="module")
def parcels(spark):
    """Parcels of five zones; those are late (label 1) that are heavy for their price, except in zone 4."""
    rows = [(k, 0.5 + (k * 37 % 101) / 10, 2.0 + (k * 53 % 89) / 20, f"z{k * 7 % 5}", k // 3 % 2) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, weight double, price double, zone string, fold int")
    return df.withColumn("label", ((F.col("weight") > 1.2 * F.col("price")) & (F.col("zone") != "z4")).cast("double")).persist()


ROWWISE = {
    "add": lambda w, p: w + p,
    "subtract": lambda w, p: w - p,
    "multiply": lambda w, p: w * p,
    "divide": lambda w, p: w / p if p else None,
}
UNARY = {"abs": abs, "square": lambda w: w * w, "sqrt_abs": lambda w: abs(w) ** 0.5, "log1p_abs": lambda w: math.log1p(abs(w)), "is_missing": lambda w: float(w is None), "clip": lambda w: min(max(w, -1.5), 0.25)}


@pytest.mark.parametrize("weight, price", [(-2.25, 0.5), (0.0, -3.0), (7.5, 0.0), (-0.125, 1e6), (1e-9, 4.0), (None, 2.0)])
def test_rowwise_operators(spark, weight, price):
    """Each operator against its definition; what has no value is missing."""
    df = spark.createDataFrame([(weight, price, "z0")], "weight double, price double, zone string")
    features = [Feature(f"o_{op}", op, ("weight", "price")) for op in ROWWISE]
    features += [Feature(f"o_{op}", op, ("weight",), {"lower": -1.5, "upper": 0.25} if op == "clip" else {}) for op in UNARY]
    row = fit(df, PARCELS, features).transform(df).first()
    for op, f in ROWWISE.items():
        assert row[f"o_{op}"] == (None if weight is None else pytest.approx(f(weight, price)))
    for op, f in UNARY.items():
        assert row[f"o_{op}"] == (None if weight is None and op != "is_missing" else pytest.approx(f(weight)))


def test_statistics_by_zone(spark, parcels, tmp_path):
    """Means, deviations and frequencies of one fold, looked up for the other and for a zone that nobody has seen."""
    train, test = parcels.where("fold = 0"), parcels.where("fold = 1").unionByName(parcels.limit(1).withColumn("zone", F.lit("elsewhere")))
    model = fit(train, PARCELS, [Feature("mean", "group_mean", ("zone", "weight")), Feature("spread", "group_std", ("zone", "weight")), Feature("share", "frequency", ("zone",))])
    seen, by = train.collect(), {}
    for r in seen:
        by.setdefault(r.zone, []).append(r.weight)
    every = [r.weight for r in seen]
    mean = lambda x: sum(x) / len(x)
    spread = lambda x: (sum((v - mean(x)) ** 2 for v in x) / len(x)) ** 0.5
    found = model.transform(test.withColumn("where", F.col("zone")), keep=("where",)).collect()
    assert any(r["where"] == "elsewhere" for r in found)
    for r in found:
        own = by.get(r["where"], every)
        assert (r["mean"], r["spread"], r["share"]) == pytest.approx((mean(own), spread(own), len(by.get(r["where"], [])) / len(seen)))
    model.save(str(tmp_path / "kept"))
    again = FeatureModel.load(spark, str(tmp_path / "kept"), Dataset.parse(PARCELS))
    assert sorted(again.transform(test).collect()) == sorted(model.transform(test).collect())


def test_dates_and_pairs(spark):
    data = {"fields": [field("sent", "datetime"), field("due", "datetime"), field("zone", "categorical"), field("kind", "categorical")]}
    rows = [(1, "2024-02-28", "2024-03-01", "z1", "box"), (2, "2023-12-31", None, None, "box"), (3, "2024-02-28", "2024-02-27", "z1", None), (4, None, None, "None", "N:")]
    df = spark.createDataFrame(rows, "id int, sent string, due string, zone string, kind string")
    features = [Feature("left", "days_between", ("due", "sent")), Feature("y", "year", ("sent",)), Feature("m", "month", ("sent",)), Feature("d", "dayofweek", ("sent",)), Feature("open", "is_missing", ("due",)), Feature("pair", "cross", ("zone", "kind"))]
    out = fit(df, data, features).transform(df, keep=("id",)).orderBy("id").collect()
    assert [r.left for r in out] == [2, None, -1, None] and [r.open for r in out] == [0, 1, 0, 1]
    assert [(r.y, r.m, r.d) for r in out] == [(2024, 2, 2), (2023, 12, 6), (2024, 2, 2), (None, None, None)]  # Monday is 0
    assert len({r.pair for r in out}) == 4  # a missing value is none of the texts
    other = fit(df, data, [Feature("pair", "cross", ("kind", "zone"))]).transform(df, keep=("id",)).orderBy("id").collect()
    assert [r.pair for r in other] == [r.pair for r in out]


def test_infinity_and_nan(spark):
    df = spark.createDataFrame([(float("inf"), 1.0, "a"), (float("nan"), 1.0, "a"), (1e200, 1e200, "a")], "weight double, price double, zone string")
    r = fit(df, PARCELS, [Feature("p", "multiply", ("weight", "price")), Feature("c", "clip", ("p",), {"lower": 0.0, "upper": 9.0}), Feature("m", "is_missing", ("p",))]).transform(df).collect()
    assert [x.p for x in r] == [None] * 3 and [x.c for x in r] == [9.0, None, 9.0] and [x.m for x in r] == [0, 1, 0]


def test_plans_stay_in_the_engine(spark, parcels):
    model = fit(parcels, PARCELS, [Feature("m", "group_mean", ("zone", "weight")), Feature("s", "group_std", ("zone", "weight")), Feature("q", "square", ("m",))])
    assert len(model.lookups[1]) == 1  # one aggregate for both
    assert "Python" not in model.transform(parcels)._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad", [dict(op="nope"), dict(inputs=("weight",)), dict(params={"lower": 1.0}), dict(name="1x"), dict(op="clip", inputs=("weight",), params={"lower": 2.0, "upper": 1.0}), dict(op="clip", inputs=("weight",), params={"lower": float("nan"), "upper": 1.0})])
def test_bad_features(bad):
    with pytest.raises(ContractError):
        Feature(**{"name": "x", "op": "add", "inputs": ("weight", "price")} | bad)


def test_bad_sets():
    data = Dataset.parse({"fields": [*PARCELS["fields"], field("secret", exclude=True)]})
    for f in (Feature("x", "abs", ("none",)), Feature("x", "abs", ("x",)), Feature("x", "abs", ("zone",)), Feature("weight", "abs", ("price",)), Feature("x", "abs", ("secret",)), Feature("secret", "abs", ("weight",))):
        with pytest.raises(ContractError):
            Graph.of(data, [f])
    with pytest.raises(ContractError):
        Graph.of(data, [Feature("x", "add", ("weight", "price")), Feature("y", "add", ("price", "weight"))])
    with pytest.raises(ContractError):
        Graph.of(data, [Feature("x", "abs", ("y",)), Feature("y", "abs", ("x",))])
    with pytest.raises(ContractError):
        check_params({"a": True}, {"a": [1]})
    with pytest.raises(ContractError):
        Dataset.parse({"fields": [field("a", "vector")]})


def test_hashes():
    data = Dataset.parse(PARCELS)
    fs = [Feature("x", "add", ("weight", "price")), Feature("y", "square", ("x",))]
    turned = [Feature("y", "square", ("x",)), Feature("x", "add", ("price", "weight"))]
    named = [Feature("u", "add", ("weight", "price")), Feature("v", "square", ("u",))]
    a, b, c = (Graph.of(data, x) for x in (fs, turned, named))
    assert a.hash == b.hash != c.hash and [n.expression for n in a.nodes] == [n.expression for n in c.nodes] and a.leaves() == ["y"]
    records = a.records()
    assert Graph.load(data, records).hash == a.hash
    with pytest.raises(ContractError):
        Graph.load(data, [records[0] | {"content_hash": "0"}, records[1]])


def test_folds(spark, parcels):
    k = folds.kfold(parcels.drop("fold"), "id", 3, 5)
    assert k.orderBy("id").collect() == folds.kfold(parcels.drop("fold").repartition(7), "id", 3, 5).orderBy("id").collect()
    g = folds.group(spark.range(120).withColumn("g", F.floor(F.col("id") / 4)), "g", 3)
    assert g.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and {r["count"] for r in g.groupBy("fold").count().collect()} == {40}
    t = folds.expanding_time(spark.range(20), ["id"]).groupBy("block").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("block").collect()
    assert len(t) == 6 and all(x.b < y.a for x, y in zip(t, t[1:]))


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.auc(df, "s", F.col("y") == 1).first().auc == pytest.approx(0.75)
    with pytest.raises(ValueError):
        metrics.check_finite({"x": float("nan")})
    assert prep.varying(spark.createDataFrame([(None, 0), (1, 1), (1, 2)], "x int, f int"), F.col("x"), "f", 3).first()[0]
    one = evidence.bootstrap(spark.createDataFrame([(1.0,)], "x double"), "x").first()
    assert one.n == 1 and one.low is None


def study(tmp, sampler, **more):
    return Study(Dataset.parse(PARCELS), "auc", "logistic", sampler, Ledger(str(tmp / "l.db")), explain=False, most=1, **more)


def test_search_resumes_and_is_deterministic(spark, parcels, tmp_path):
    (tmp_path / "b").mkdir()
    a = study(tmp_path, RandomSampler(3))
    model = a.optimize(parcels, "label", "fold", Budget(trials=2))
    assert len(a.trials) == 3 and a.trials[0]["state"] == "COMPLETE" and model is not None
    b = study(tmp_path, RandomSampler(3))
    b.optimize(parcels.repartition(5), "label", "fold", Budget(trials=3))
    c = study(tmp_path / "b", RandomSampler(3))
    c.optimize(parcels, "label", "fold", Budget(trials=3))
    assert [(t["number"], t["state"], t["hash"]) for t in b.trials] == [(t["number"], t["state"], t["hash"]) for t in c.trials]
    with pytest.raises(ContractError):
        study(tmp_path, RandomSampler(3)).optimize(parcels.withColumn("weight", F.col("weight") + 1), "label", "fold", Budget(trials=1))
    d = study(tmp_path / "b", RandomSampler(3))
    d.optimize(parcels.withColumn("weight", F.col("weight") + 1), "label", "fold", Budget(trials=0), archive=True)
    assert len(d.trials) == 1


def test_studies_share_evaluations(spark, parcels, tmp_path):
    """Another study of the same data, by another strategy, fits nothing that was fitted; other data share nothing."""
    seen = []
    for k, data in enumerate((parcels, parcels.repartition(3), parcels.withColumn("weight", F.col("weight") + 1))):
        (tmp_path / str(k)).mkdir()
        s = study(tmp_path / str(k), RandomSampler(3), strategy="independent" if k else "greedy", artifacts=Artifacts(str(tmp_path / "kept")))
        s.optimize(data, "label", "fold", Budget(trials=1))
        seen.append(([(t["state"], t["metrics"]) for t in s.trials], sum(t["fits"] for t in s.trials), s.artifacts.hits))
    assert seen[0][0] == seen[1][0] and [x[1:] for x in seen] == [(4, 0), (0, 2), (4, 0)]


def test_artifacts_are_whole_and_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.sources.artifacts.ENTRIES", 2)
    for store in (Artifacts(), Artifacts(str(tmp_path))):
        for k in range(3):
            store.put("s", [k], {"v": k})
        assert store.get("s", [2]) == {"v": 2} and store.get("t", [2]) is None
        assert store.get("s", [0]) == (None if store.folder is None else {"v": 0})
        with pytest.raises(ValueError):
            store.put("s", [4], float("nan"))
    assert len(list((tmp_path / "s").iterdir())) == 3
    next((tmp_path / "s").iterdir()).write_text("{")
    with pytest.raises(ValueError):
        [store.get("s", [k]) for k in range(3)]


def test_interruption_budget_and_duplicates(spark, parcels, tmp_path):
    class Same:
        def sample(self, context):
            return Proposal((Feature(f"f{context.number}", "divide", ("weight", "price"), hypothesis=Hypothesis("ratio", "debt", "increasing")),))

    s = study(tmp_path, Same(), strategy="independent")
    assert s.optimize(parcels, "label", "fold", Budget(fits=1)) is None and not s.trials
    s.optimize(parcels, "label", "fold", Budget(trials=1))
    assert s.trials[1]["hypotheses"]["f1"]["status"] in ("inconclusive", "rejected")
    s.ledger.save(s._blank(2, s.trials[0]), "study")
    again = study(tmp_path, Same(), strategy="independent")
    again.optimize(parcels, "label", "fold", Budget(fits=5))
    assert again.trials[2]["state"] == "INTERRUPTED" and again.trials[3]["state"] == "BUDGET_EXCEEDED"
    with again.ledger.lock(), pytest.raises(LedgerLocked), again.ledger.lock():
        pass


def test_samplers_and_model_replies():
    data = Dataset.parse(PARCELS)
    context = Context(data, Graph.of(data, []), 4, [])
    assert RandomSampler(1).sample(context) == RandomSampler(1).sample(context)
    done = [{"number": 1, "state": "COMPLETE", "value": 0.9, "features": [Feature("f1_0", "divide", ("weight", "price")).record()], "parent_hash": "", "removed": []}]
    assert EvolutionSampler(1).sample(Context(data, Graph.of(data, []), 2, done)).features[0].op == "divide"
    full = Graph.of(data, [Feature("x", "abs", ("weight",))])
    assert AutonomousSampler(RandomSampler(1)).sample(Context(data, full, 4, [])).remove == ("x",)
    replies = iter([b'{"features": [{"name": "bad", "op": "no", "inputs": ["weight"]}]}', b'```json\n{"features": [{"name": "r", "op": "divide", "inputs": ["weight", "price"]}]}\n```'])
    seen = []

    def transport(url, headers, body):
        seen.append(body)
        return 200, json.dumps({"choices": [{"message": {"content": next(replies).decode()}}], "usage": {"prompt_tokens": 5, "completion_tokens": 7}}).encode()

    client = Client("https://example.org/v1", "m", "secret", transport, price=(1.0, 2.0))
    p = HybridSampler(ModelSampler(client), RandomSampler(1), 3).sample(context)
    assert p.features[0].name == "r" and client.tokens == [10, 14] and client.cost == pytest.approx(38e-6) and b'"no"' not in seen[1]
    assert "secret" not in repr(client)
    with pytest.raises(ContractError):
        Client("http://example.org", "m")
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "no"):
        with pytest.raises(ContractError):
            strict_json(bad)


def test_prompt_is_bounded():
    data = Dataset.parse({"fields": [field(f"x{k}") | {"description": "d" * 300} for k in range(500)]})
    text = prompt(Context(data, Graph.of(data, []), 1, [], statistics={"x1": {"v": "s" * 9000}}))
    assert len(text.encode()) <= 12_000 and len(json.loads(text)["columns"]) <= 20


def test_wide_contract_and_prompt_in_the_loop(spark, parcels, tmp_path):
    extra = [field(f"d{k}") for k in range(30)]
    wide = parcels.select("*", *((F.col("weight") * (k + 1)).alias(f"d{k}") for k in range(30)))
    asked = []

    class Shown:
        def sample(self, context):
            asked.append((context.columns, json.loads(prompt(context))))
            return Proposal((Feature(f"f{context.number}", "divide", ("weight", "price"), hypothesis=Hypothesis("ratio", "debt")),))

    s = Study(Dataset.parse({"fields": [*PARCELS["fields"], *extra], "objective": "late parcels"}), "auc", "logistic", Shown(), Ledger(str(tmp_path / "l.db")), explain=False, most_columns=6)
    s.optimize(wide, "label", "fold", Budget(trials=2))
    columns, told = asked[0]
    assert len(columns) == 6 and "weight" in columns and set(told["statistics"]) <= set(columns) and told["statistics"]["weight"]["missing_rate"] == 0
    assert asked[1][1]["memory"]["recent"][0]["number"] == 1


def test_busy_replies_of_the_real_transport_are_tried_again():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Busy(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(self.path)
            body = json.dumps({"choices": [{"message": {"content": "done"}}]}).encode()
            self.send_response(503 if len(seen) < 3 else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert Client(f"http://127.0.0.1:{server.server_port}/v1", "m").ask([]) == "done" and len(seen) == 3
    server.shutdown()


def test_bootstrap_refuses_what_it_would_cut(spark, monkeypatch):
    monkeypatch.setattr(evidence, "BOOTSTRAP_VALUES", 5)
    with pytest.raises(ValueError):
        evidence.bootstrap(spark.range(6).select(F.col("id").cast("double").alias("x")), "x")


def test_command_line(spark, parcels, tmp_path, capsys):
    from tessera.cli import load_config, main

    parcels.select("weight", "price", F.col("label").cast("int").alias("default")).coalesce(1).write.parquet(str(tmp_path / "parcels.parquet"))
    config = {"data": "parcels.parquet", "schema": {"fields": PARCELS["fields"][:2]}, "target": "default", "metric": "auc", "estimator": "logistic", "folds": 2, "budget": {"trials": 1}, "name": "<b>s</b>"}
    config["name"] = "s"
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert main(["optimize", str(tmp_path / "c.json")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["trials"] == 2
    assert main(["inspect", str(tmp_path / "output/ledger.db"), "--study", "s"]) == 0
    assert main(["export", str(tmp_path / "output/ledger.db"), "--study", "s", "--out", str(tmp_path / "f.json")]) == 0
    assert "<svg" in (tmp_path / "output/report.html").read_text()
    (tmp_path / "bad.json").write_text(json.dumps(config | {"sampler": {"api_key": "x"}}))
    with pytest.raises(ContractError):
        load_config(str(tmp_path / "bad.json"))


def test_report_escapes():
    from tessera.report import render

    assert "<script>" not in render("<script>", [])


def test_stream_equals_batch(spark, parcels, tmp_path):
    from tessera.streaming.transform import transform_stream

    path = str(tmp_path / "in")
    parcels.write.parquet(path)
    model = fit(parcels, PARCELS, [Feature("m", "group_mean", ("zone", "weight"))])
    out = transform_stream(spark.readStream.schema(parcels.schema).parquet(path), model, keep=("id",))
    q = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("streamed").collect()) == sorted(model.transform(parcels, keep=("id",)).collect())
    with pytest.raises(ValueError):
        transform_stream(parcels, model)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_places_follow_the_order_within_groups(spark):
    rows = [(i, f"g{i % 7 and 1}" if i % 11 else None, float(i * 7919 % 500) if i % 13 else None, f"k{i * 31 % 400:03d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, x double, s string")
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for column, at in (("x", 2), ("s", 3)):
        for by in ((), ("g",)):
            groups = {}
            for r in sorted(rows, key=lambda r: (none_first(r[at]), r[0])):
                groups.setdefault(r[1] if by else "", []).append(r[0])
            want = {i: (k, len(ids)) for ids in groups.values() for k, i in enumerate(ids)}
            found = folds.placed(df, [F.col(column), F.col("id")], by).collect()
            assert {r["id"]: (r["__place"], r["__total"]) for r in found} == want
    assert folds.placed(df.limit(0), [F.col("x")]).count() == 0


def test_curves_ranks_and_groups_in_ranges_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(folds, "RANGES", 7)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(400), "s": np.round(rng.normal(size=400), 1), "z": rng.normal(size=400), "y": rng.integers(0, 2, 400), "g": rng.integers(0, 3, 400), "own": (rng.pareto(0.7, 400) * 3).astype(int) % 90})
    df = spark.createDataFrame(pdf)

    def pairs(p):
        hit, other = p.s[p.y == 1].to_numpy(), p.s[p.y == 0].to_numpy()
        return ((hit[:, None] > other).sum() + (hit[:, None] == other).sum() / 2) / (len(hit) * len(other))

    assert metrics.auc(df, "s", F.col("y") == 1).first().auc == pytest.approx(pairs(pdf))
    for small in (False, True):
        per = {r.g: r.auc for r in metrics.auc(df, "s", F.col("y") == 1, ["g"], small=small).collect()}
        assert per == {k: pytest.approx(pairs(p)) for k, p in pdf.groupby("g")}
    rho = {r.g: r.rho for r in metrics.spearman(df, "s", "z", ["g"]).collect()}
    assert rho == {k: pytest.approx(p.s.rank().corr(p.z.rank())) for k, p in pdf.groupby("g")}
    assert metrics.spearman(df.withColumn("c", F.lit(1)), "s", "c", []).first().rho is None
    assert metrics.auc(df.limit(0), "s", F.col("y") == 1).first().auc is None

    sizes = pdf.own.value_counts()
    order = sorted(sizes.index, key=lambda v: (-sizes[v], v))
    turn = {v: i % 8 if i % 8 < 4 else 7 - i % 8 for i, v in enumerate(order)}
    assert all(r.fold == turn[r.own] for r in folds.group(df, "own", 4).collect())
    levels = {r.value: r.slot for r in prep.ranked_levels(df, "own", 5).collect()}
    assert levels == {v: min(i, 4) for i, v in enumerate(order)}


def test_fitted_pipelines_are_saved_and_predict(spark, parcels, tmp_path):
    from tessera.operators.evaluate import ESTIMATORS, FoldPipeline, default_estimator, explain_holdout

    many = parcels.withColumn("zone", F.concat("zone", F.lit("-"), F.col("id") % 140))
    study = Study(PARCELS, "auc", None, RandomSampler(1), Ledger(str(tmp_path / "l.db")), explain=False, log=str(tmp_path / "search.log"))
    assert study.estimator == "logistic" and default_estimator("rmse") == "ridge"
    study.optimize(many, "label", "fold", Budget(trials=1))
    assert "trial 1 " in (tmp_path / "search.log").read_text() and study.refit(many.limit(100), "label") is not None
    raw = many.drop("label")
    for name in ("logistic", "forest_classifier"):
        graph = Graph.of(Dataset.parse(PARCELS), [Feature("ratio", "divide", ("weight", "price")), Feature("by_zone", "group_mean", ("zone", "weight"))])
        pipe = FoldPipeline(graph, "label", ESTIMATORS[name], {}, 2).fit(many, ("label",))
        assert pipe.rare
        for _ in range(2):  # the second replaces the first
            pipe.save(str(tmp_path / name))
        loaded = FoldPipeline.load(spark, str(tmp_path / name))
        before, after = ({r.id: (r.prediction, *r.p) for r in p.apply(raw, ("id",)).collect()} for p in (pipe, loaded))
        assert len(after) == 150 and after == {k: pytest.approx(v) for k, v in before.items()}
        assert len(loaded.apply(raw, ("zone", "weight")).columns) == 4
    gain = explain_holdout(loaded, many, "accuracy", "id")
    assert set(gain) == {"weight", "price", "zone", "ratio", "by_zone"} and gain["ratio"] == max(gain.values()) > 0
    assert [p.name for p in tmp_path.iterdir() if "logistic" in p.name] == ["logistic"]


def test_full_parents_are_passed_over(tmp_path):
    study = Study(PARCELS, "auc", "logistic", RandomSampler(1), Ledger(str(tmp_path / "l.db")), capacity=2)
    row = lambda name, *inputs: {"name": name, "inputs": list(inputs)}
    trial = lambda k, value, features, parent=0, removed=(): study._blank(k) | {"state": "COMPLETE", "value": value, "features": features, "parent": parent, "removed": list(removed)}
    study.trials = [trial(0, 0.5, []), trial(1, 0.9, [row("a", "weight"), row("b", "a")]), trial(2, 0.7, [row("c", "price")])]
    assert study.parent_of(3)["number"] == 1  # b can go
    study.trials.append(trial(3, 0.6, [row("a", "weight")], 1, ["b"]))
    assert study.parent_of(4)["number"] == 2


def test_bills_are_kept_in_the_ledger_and_unknown_ones_end_the_search(spark, parcels, tmp_path):
    def reply(usage):
        text = json.dumps({"features": [], "remove": []})
        return lambda url, headers, body: (200, json.dumps({"choices": [{"message": {"content": text}}], **usage}).encode())

    def run(usage, budget):
        client = Client("https://example.org", "m", transport=reply(usage), price=(1.0, 2.0))
        study = Study(PARCELS, "auc", "logistic", ModelSampler(client), Ledger(str(tmp_path / "l.db")), explain=False)
        study.optimize(parcels, "label", "fold", budget)
        return study.used(), client.requests

    known = {"usage": {"prompt_tokens": 10, "completion_tokens": 5}}
    first, asked = run(known, Budget(trials=1))
    assert first["tokens"] == 15 * asked and first["cost"] == pytest.approx(20e-6 * asked)
    second, more = run(known, Budget(trials=2))
    assert more > 0 and second["tokens"] == 15 * (asked + more)
    assert run(known, Budget(tokens=15))[1] == 0
    unknown, _ = run({}, Budget(trials=3))
    assert unknown["cost"] == float("inf") and run(known, Budget(cost=1e9))[1] == 0


def test_command_line_picks_the_best_by_the_metric(tmp_path, capsys):
    from tessera.cli import main
    from tessera.sources.ledger import Ledger

    path = str(tmp_path / "ledger.db")
    for number, value in enumerate((0.9, 0.4, 0.7)):
        Ledger(path).save({"number": number, "state": "COMPLETE", "value": value, "features": [number]}, "study", {"metric": "rmse"})
    assert main(["inspect", path]) == 0
    assert json.loads(capsys.readouterr().out)["best"] == {"number": 1, "value": 0.4}


@pytest.mark.parametrize("kinds, width", [(32, 32), (128, 128), (129, 128), (140, 128)])
def test_one_hot_keeps_128_values_and_a_place_for_the_rare(spark, kinds, width):
    from tessera.operators.evaluate import ESTIMATORS, FoldPipeline

    data = Dataset.parse({"fields": [field("zone", "categorical")]})
    rows = [(f"k{k:03}", float(j % 2)) for k in range(kinds) for j in range(3 if k < 127 else 2)]
    train = spark.createDataFrame(rows, "zone string, label double")
    pipe = FoldPipeline(Graph.of(data, []), "label", ESTIMATORS["logistic"], {}, 2).fit(train, ("label",))
    seen = spark.createDataFrame([(f"k{k:03}", 0.0) for k in range(kinds)] + [("new", 0.0)], "zone string, label double")
    ready = pipe.prepare(pipe.features.transform(seen, keep=("label",))).collect()
    hot = [tuple(r.features.toArray().nonzero()[0]) for r in ready]
    assert all(len(r.features) == width for r in ready) and sorted(map(len, hot)) == [0] + [1] * kinds
    assert len(set(hot)) == width + 1 and max(map(hot.count, hot)) == max(1, kinds - 127)
    pipe.release()
