"""Command line: optimize a configuration, or inspect, report and export what a ledger holds."""

from __future__ import annotations

import argparse
import json
import os

from tessera import report
from tessera.contracts import Dataset, need
from tessera.sources.ledger import Ledger


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    need(not any("api_key" in str(k).lower() for k in (*config, *(config.get("sampler") or {}))), "keys don't belong into configurations; name an environment variable in key_env")
    config["folder"] = os.path.dirname(os.path.abspath(path))
    return config


def sampler_of(s: dict, seed: int):
    """The sampler that a configuration names; those that combine others take them from the same block."""
    from tessera.search.samplers import AutonomousSampler, Client, EvolutionSampler, HybridSampler, ModelSampler, RandomSampler

    def model():
        return ModelSampler(Client(s["url"], s["model"], os.environ.get(s.get("key_env", ""), "")))

    kinds = {
        "random": lambda: RandomSampler(seed),
        "evolution": lambda: EvolutionSampler(seed),
        "model": model,
        "hybrid": lambda: HybridSampler(model(), EvolutionSampler(seed), s.get("every", 3)),
        "autonomous": lambda: AutonomousSampler(model() if "url" in s else RandomSampler(seed), s.get("remove_every", 4)),
    }
    need(s.get("kind") in kinds, f"unknown sampler {s.get('kind')}")
    return kinds[s["kind"]]()


def best_of(trials: list[dict], maximize: bool) -> dict | None:
    """The best complete trial in the direction of the study's metric; of equals, the first."""
    done = [t for t in trials if t["state"] == "COMPLETE" and t["value"] is not None]
    return min(done, key=lambda t: (-t["value"] if maximize else t["value"], t["number"]), default=None)


def optimize(config: dict) -> dict:
    from pyspark.sql import SparkSession

    from tessera.operators import folds
    from tessera.search.study import Budget, Study

    spark = SparkSession.builder.getOrCreate()
    at = lambda p: os.path.join(config["folder"], p)
    data, schema = at(config["data"]), config["schema"]
    if isinstance(schema, str):
        with open(at(schema), encoding="utf-8") as f:
            schema = json.load(f)
    df = spark.read.parquet(data) if data.endswith(".parquet") else spark.read.csv(data, header=True, inferSchema=True)
    label, k = config["target"], config.get("folds", 3)
    from pyspark.sql import functions as F

    if config.get("groups"):
        df = folds.group(df, config["groups"], k)
    else:
        df = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(config.get("seed", 0)), *df.columns), F.lit(k)).cast("int"))
    sampler = sampler_of(config.get("sampler", {"kind": "random"}), config.get("seed", 0))
    out = at(config.get("output", "output"))
    os.makedirs(out, exist_ok=True)
    study = Study(Dataset.parse(schema), config["metric"], config.get("estimator"), sampler, Ledger(os.path.join(out, "ledger.db")), config.get("name", "study"), config.get("strategy", "greedy"), most=config.get("features_per_trial", 2), log=os.path.join(out, "search.log"))
    df = df.withColumn(label, F.col(label).cast("double"))
    model = study.optimize(df, label, "fold", Budget(**config.get("budget", {"trials": 3})))
    best = study.best()
    if model:
        study.refit(df, label).save(os.path.join(out, "pipeline"))
    report.write(os.path.join(out, "features.json"), json.dumps({"features": [{k: r[k] for k in ("name", "op", "inputs", "params", "hypothesis")} for r in (best or {}).get("features", [])]}))
    report.write(os.path.join(out, "trials.json"), json.dumps(study.trials))
    report.write(os.path.join(out, "report.html"), report.render(study.name, study.trials, study.maximize))
    return {"study": study.name, "trials": len(study.trials), "best": best and {"number": best["number"], "value": best["value"]}, "output": out}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("optimize").add_argument("config")
    for name in ("inspect", "report", "export"):
        p = sub.add_parser(name)
        p.add_argument("ledger")
        p.add_argument("--study", default="study")
        if name != "inspect":
            p.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "optimize":
        print(json.dumps(optimize(load_config(args.config))))
        return 0
    from tessera.operators.metrics import DIRECTION

    need(os.path.exists(args.ledger), f"no ledger at {args.ledger}")
    ledger = Ledger(args.ledger)
    trials = ledger.trials(args.study)
    maximize = DIRECTION.get((ledger.meta(args.study) or {}).get("metric"), "maximize") == "maximize"
    best = best_of(trials, maximize)
    if args.command == "inspect":
        print(json.dumps({"study": args.study, "trials": len(trials), "states": {s: sum(t["state"] == s for t in trials) for s in sorted({t["state"] for t in trials})}, "best": best and {"number": best["number"], "value": best["value"]}}))
    elif args.command == "report":
        report.write(args.out, report.render(args.study, trials, maximize))
    else:
        report.write(args.out, json.dumps({"features": best["features"] if best else []}))
    return 0
