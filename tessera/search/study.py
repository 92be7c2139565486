"""The search loop: propose, check, evaluate, record. Everything it knows is in the ledger, so it can stop and go on."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import __version__
from tessera.contracts import ContractError, Dataset, check_params, need
from tessera.operators import metrics, prep, retrieval
from tessera.operators.evaluate import ESTIMATORS, FoldPipeline, Result, default_estimator, evaluate
from tessera.plans.compiler import FeatureModel, fit
from tessera.plans.graph import Graph, digest
from tessera.search.samplers import Context, Sampler
from tessera.sources.artifacts import Artifacts
from tessera.sources.ledger import Ledger

STATES = ("RUNNING", "COMPLETE", "FAIL", "DUPLICATE", "SCREENED_OUT", "INTERRUPTED", "BUDGET_EXCEEDED")


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """Ceilings over the whole study, resumed runs included. The first that is reached ends the search."""

    trials: int | None = None
    fits: int | None = None
    seconds: float | None = None
    proposals: int | None = None
    tokens: int | None = None
    cost: float | None = None

    def spent(self, used: dict[str, float]) -> str | None:
        return next((k for k, v in used.items() if getattr(self, k) is not None and v >= getattr(self, k)), None)


def fingerprint(df: DataFrame, dataset: Dataset, columns: list[str], settings: dict) -> str:
    """Identity of data (in any order), contract and settings. Sums of hashes are decimal, so they can't overflow."""
    h = F.xxhash64(*columns)
    n, total, xor = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return digest({"data": [n, str(total), str(xor)], "schema": df.select(*columns).schema.json(), "fields": [vars(f) | {"semantic_tags": list(f.semantic_tags)} for f in dataset.fields], "settings": settings, "version": __version__})


@dataclass
class Study:
    dataset: Dataset
    metric: str
    estimator: str | None
    sampler: Sampler
    ledger: Ledger
    name: str = "study"
    strategy: str = "greedy"
    width: int = 3
    most: int = 2
    patience: int | None = None
    secondary: tuple[str, ...] = ()
    param_space: dict[str, list] = field(default_factory=dict)
    joint_optimization: bool = False
    explain: bool = True
    most_columns: int = 20
    #: Derived features that a trial's graph may have; a parent that is full and has no untried removal of a leaf left is passed over.
    capacity: int | None = None
    #: A file for one line per trial.
    log: str | None = None
    callbacks: tuple[Callable[[Study, dict], None], ...] = ()
    #: Shared by studies of the same data, whatever their samplers and strategies: what one has evaluated, another need not fit.
    artifacts: Artifacts | None = None
    trials: list[dict] = field(default_factory=list)
    stopped: bool = False

    def __post_init__(self):
        self.dataset = Dataset.parse(self.dataset)
        need(self.metric in metrics.DIRECTION, f"unknown metric {self.metric}")
        need(self.strategy in ("independent", "greedy", "beam", "autonomous"), f"unknown strategy {self.strategy}")
        need(bool(self.name) and "/" not in self.name and self.name not in (".", ".."), "a study's name is one path component")
        need(not self.param_space or self.joint_optimization, "a parameter space needs joint optimization")
        self.estimator = self.estimator or default_estimator(self.metric)
        if self.strategy == "autonomous" and self.patience is None:
            self.patience = 8

    @property
    def maximize(self) -> bool:
        return metrics.DIRECTION[self.metric] == "maximize"

    def stop(self) -> None:
        self.stopped = True

    def best(self) -> dict | None:
        done = [t for t in self.trials if t["state"] == "COMPLETE"]
        return min(done, key=lambda t: (-t["value"] if self.maximize else t["value"], t["number"]), default=None)

    def graph(self, trial: dict) -> Graph:
        return Graph.load(self.dataset, trial["features"])

    def _expandable(self, trial: dict) -> bool:
        if self.capacity is None or len(trial["features"]) < self.capacity:
            return True
        inputs = {x for f in trial["features"] for x in f["inputs"]}
        tried = {x for t in self.trials if t["parent"] == trial["number"] for x in t["removed"]}
        return any(f["name"] not in inputs | tried for f in trial["features"])

    def parent_of(self, number: int) -> dict:
        k = self.width if self.strategy == "beam" else 1
        cutoff = (number - 1) // k * k if self.strategy == "beam" else number - 1
        base = self.trials[0]
        if self.strategy == "independent":
            return base
        ok = [t for t in self.trials if t["state"] == "COMPLETE" and t["number"] <= cutoff and self._expandable(t)]
        frontier = sorted(ok, key=lambda t: (-t["value"] if self.maximize else t["value"], t["number"]))[:k]
        return frontier[(number - 1) % len(frontier)] if frontier else base

    def memory(self, k: int = 5, recent: int = 5) -> dict:
        """The history in a few lines: the most frequent useful and rejected concepts and failures (ties: first seen), and the last trials."""
        useful, rejected, failed = Counter(), Counter(), Counter()
        for t in self.trials:
            for h in t["hypotheses"].values():
                if h["status"] in ("supported", "strongly_supported"):
                    useful[h["concept"]] += 1
                elif h["status"] == "rejected":
                    rejected[h["concept"]] += 1
            if t["state"] == "FAIL" and t["error"]:
                failed[t["error"][:120]] += 1
        last = [{x: t[x] for x in ("number", "state", "parent_delta")} for t in self.trials[1:][-recent:]]
        return {"useful": useful.most_common(k), "rejected": rejected.most_common(k), "failures": failed.most_common(k), "recent": last}

    def _statistics(self, df: DataFrame):
        """Summaries of columns for a prompt, without rows, labels or names of categories: computed once per column, when first asked for."""
        known: dict[str, dict] = {}
        kinds = {f.name: f.dtype for f in self.dataset.usable}

        def of(names: list[str]) -> dict[str, dict]:
            new = [n for n in names if n not in known and kinds.get(n) in ("numeric", "categorical")]
            if new:
                rows = prep.summaries(df, [n for n in new if kinds[n] == "numeric"], [n for n in new if kinds[n] == "categorical"]).collect()
                known.update({r["column"]: {k: v for k, v in r.asDict().items() if k != "column" and v is not None} for r in rows})
            return {n: known[n] for n in names if n in known}

        return of

    def _columns(self, df: DataFrame, number: int) -> list[str] | None:
        """Of wide contracts, the columns that a trial is shown: half by similarity to the objective, half drawn."""
        fields = self.dataset.usable
        if len(fields) <= self.most_columns:
            return None
        rows = [(f.name, f.concept, " ".join([f.name, f.description, *f.semantic_tags])) for f in fields]
        wide = df.sparkSession.createDataFrame(rows, "name string, concept string, document string")
        wanted = " ".join([self.dataset.objective, self.dataset.target_definition, self.dataset.search_guidance]).strip() or self.metric
        return [r["name"] for r in retrieval.hybrid(wide, wanted, self.most_columns, 0, number).collect()]

    def used(self) -> dict[str, float]:
        """What all trials in the ledger took, those of earlier runs too. A bill that is unknown in part passes any ceiling on cost."""
        done, bills = [t for t in self.trials if t["number"] > 0], [t["bill"] for t in self.trials if t.get("bill")]
        cost = float("inf") if any(b["cost"] is None for b in bills) else sum(b["cost"] for b in bills)
        return {"trials": len(done), "fits": sum(t["fits"] for t in self.trials), "seconds": sum(t["duration"] for t in self.trials), "proposals": sum(t["valid_proposal"] for t in done), "tokens": sum(b["tokens"] for b in bills), "cost": cost}

    def _sample(self, trial: dict, context: Context):
        """A proposal; the trial keeps the bill of the requests for it, failed ones included."""
        client = getattr(self.sampler, "client", None)
        state = lambda: (client.requests, sum(client.tokens), client.unknown, sum(n * p for n, p in zip(client.tokens, client.price, strict=True)) / 1e6 if client.price else None)
        before = state() if client else None
        try:
            return self.sampler.sample(context)
        finally:
            after = state() if client else None
            if client and after[0] > before[0]:
                known = after[2] == before[2] and after[3] is not None
                trial["bill"] = {"requests": after[0] - before[0], "tokens": after[1] - before[1], "cost": after[3] - before[3] if known else None}

    def _save(self, trial: dict) -> None:
        if len(self.trials) > trial["number"]:
            self.trials[trial["number"]] = trial
        else:
            self.trials.append(trial)
        self.ledger.save(trial, self.name, {"fingerprint": self.identity, "metric": self.metric})

    def optimize(self, df: DataFrame, label: str, fold: str, budget: Budget, archive: bool = False, row_id: str | None = None) -> FeatureModel | None:
        """Runs until a budget, patience or ``stop`` ends it; returns the best features fitted on all rows."""
        need(label not in {f.name for f in self.dataset.usable}, "the label can't be a field")
        need(df.where(F.col(label).isNull()).limit(1).count() == 0, "the label has missing values")
        self.dataset.check(df.schema)
        with self.ledger.lock():
            self.space = fingerprint(df, self.dataset, [*(f.name for f in self.dataset.usable), label, fold], {})
            self.identity = digest({"data": self.space, "settings": {"metric": self.metric, "estimator": str(self.estimator), "strategy": self.strategy, "sampler": type(self.sampler).__name__}})
            meta = self.ledger.meta(self.name)
            if meta and meta["fingerprint"] != self.identity:
                need(archive, "this study was made from other data or settings")
                self.ledger.archive(self.name)
            self.trials = self.ledger.trials(self.name)
            for t in self.trials:
                if t["state"] == "RUNNING":  # its work is lost, what it spent isn't
                    self._save(t | {"state": "INTERRUPTED"})
            frame = df.persist()
            self.statistics_of = self._statistics(frame)
            logger, handler = self._logger()
            try:
                self._loop(frame, label, fold, budget, row_id)
            finally:
                frame.unpersist()
                if handler:
                    logger.removeHandler(handler)
                    handler.close()
        top = self.best()
        return fit(df, self.dataset, self.graph(top)) if top else None

    def refit(self, df: DataFrame, label: str) -> FoldPipeline | None:
        """The best trial's whole pipeline, estimator included, fitted on all rows; it can be saved and applied to new ones."""
        top = self.best()
        if top is None:
            return None
        adapter = ESTIMATORS[self.estimator] if isinstance(self.estimator, str) else self.estimator
        classes = df.agg(F.count_distinct(label)).first()[0] if adapter.classifier else 0
        return FoldPipeline(self.graph(top), label, adapter, top["params"], classes).fit(df, (label,))

    def _logger(self) -> tuple[logging.Logger, logging.Handler | None]:
        logger = logging.getLogger(f"tessera.search.{self.name}")
        handler = logging.FileHandler(self.log, encoding="utf-8") if self.log else None
        if handler:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            logger.setLevel(logging.INFO)
            logger.addHandler(handler)
        return logger, handler

    def _loop(self, df, label, fold, budget, row_id) -> None:
        if not self.trials:
            k = df.select(fold).distinct().count()
            if budget.fits is not None and budget.fits < k:
                return
            self._run(df, label, fold, budget, row_id, self._blank(0), Graph.of(self.dataset, []), {})
        stale = 0
        while not self.stopped and not budget.spent(self.used()) and (self.patience is None or stale < self.patience):
            number, before = len(self.trials), self.best()
            trial = self._propose(df, label, fold, budget, row_id, number)
            after = self.best()
            stale = stale + 1 if before and after and after["number"] == before["number"] else 0
            logging.getLogger(f"tessera.search.{self.name}").info("trial %d %s value=%s parent=%s%s", number, trial["state"], trial["value"], trial["parent"], f" error={trial['error']!r}" if trial["error"] else "")
            for call in self.callbacks:
                call(self, trial)

    def _blank(self, number: int, parent: dict | None = None) -> dict:
        return {"number": number, "state": "RUNNING", "value": None, "parent": parent["number"] if parent else None, "parent_hash": parent["hash"] if parent else None, "features": [], "removed": [], "hash": None, "params": {}, "signature": None, "metrics": {}, "folds": [], "importance": {}, "directions": {}, "delta": None, "parent_delta": None, "hypotheses": {}, "fits": 0, "valid_proposal": False, "duration": 0.0, "error": None, "bill": None}

    def _propose(self, df, label, fold, budget, row_id, number) -> dict:
        parent = self.parent_of(number)
        graph = self.graph(parent)
        trial = self._blank(number, parent)
        self._save(trial)
        began = time.time()
        try:
            p = self._sample(trial, Context(self.dataset, graph, number, self.trials[:-1], 1 if self.strategy == "autonomous" else self.most, self.maximize, self.memory(), self.statistics_of, self._columns(df, number)))
            need(bool(p.features or p.remove or p.model_params), "empty proposal")
            names = {f.name for f in graph.features}
            need(len(set(p.remove)) == len(p.remove) and set(p.remove) <= names, "removals must be different features of the parent")
            need(self.strategy != "autonomous" or len(p.features) <= 1, "one new feature at a time")
            check_params(p.model_params, self.param_space)
            after = Graph.of(self.dataset, [*(f for f in graph.features if f.name not in p.remove), *p.features], {x.feature.name: x.source_trial for x in graph.nodes} | {f.name: number for f in p.features})
            need(self.capacity is None or len(after.features) <= self.capacity, f"at most {self.capacity} features in a trial")
            trial |= {"valid_proposal": True, "removed": list(p.remove)}
        except ContractError as e:
            trial |= {"state": "FAIL", "error": str(e), "duration": time.time() - began}
            self._save(trial)
            return trial
        return self._run(df, label, fold, budget, row_id, trial, after, p.model_params, parent, [f.name for f in p.features])

    def _run(self, df, label, fold, budget, row_id, trial, graph, params, parent=None, new=()) -> dict:
        trial |= {"features": graph.records(), "hash": graph.hash, "params": params, "signature": digest([graph.hash, params])}
        self._save(trial)
        began = time.time()
        twin = next((t for t in self.trials if t["state"] == "COMPLETE" and t["signature"] == trial["signature"]), None)
        try:
            if twin:
                trial |= {k: twin[k] for k in ("value", "metrics", "folds", "importance", "directions")} | {"state": "DUPLICATE"}
            elif new and not self._varies(df, graph, new, fold):
                trial["state"] = "SCREENED_OUT"
            else:
                def charge():
                    if budget.fits is not None and self.used()["fits"] >= budget.fits:
                        raise BudgetExceeded("fits")
                    trial["fits"] += 1
                    self._save(trial)

                found = self._evaluate(df, graph, label, fold, params, charge, row_id)
                self._complete(trial, found, parent, new)
        except BudgetExceeded as e:
            trial |= {"state": "BUDGET_EXCEEDED", "error": str(e)}
        except Exception as e:
            trial |= {"state": "FAIL", "error": f"{type(e).__name__}: {str(e)[:500]}"}
        finally:
            trial["duration"] = time.time() - began
            self._save(trial)
        return trial

    def _evaluate(self, df, graph, label, fold, params, charge, row_id) -> Result:
        names, explain = [self.metric, *self.secondary], self.explain and bool(graph.nodes)
        # An estimator given as an object has no identity that outlives the process.
        key = [[[r["name"], r["content_hash"]] for r in graph.records()], label, fold, names, self.estimator, params, explain, row_id] if self.artifacts and isinstance(self.estimator, str) else None
        known = self.artifacts.get(self.space, key) if key else None
        if known:
            return Result(**known)
        found = evaluate(df, graph, label, fold, names, self.estimator, params, explain, charge, row_id)
        if key:
            self.artifacts.put(self.space, key, asdict(found))
        return found

    def _varies(self, df, graph, new, fold) -> bool:
        """Whether any new column varies in some training fold; statistics of all rows do for this test."""
        model = fit(df, self.dataset, graph)
        frame = model.transform(df, keep=(fold,))
        k = frame.agg(F.max(fold)).first()[0] + 1
        try:
            return any(prep.varying(frame, F.col(n), fold, k).first()[0] for n in new)
        finally:
            model.release()

    def _complete(self, trial: dict, r: Result, parent: dict | None, new) -> None:
        trial |= {"state": "COMPLETE", "value": r.metrics[self.metric], "metrics": r.metrics, "folds": r.folds, "importance": r.importance, "directions": r.directions}
        if parent is None:
            return
        sign = 1 if self.maximize else -1
        trial["delta"] = trial["value"] - self.trials[0]["value"] if self.trials[0]["value"] is not None else None
        trial["parent_delta"] = trial["value"] - parent["value"]
        better = sum(sign * (a[self.metric] - b[self.metric]) > 0 for a, b in zip(r.folds, parent["folds"], strict=False))
        for record in trial["features"]:
            name, h = record["name"], record.get("hypothesis")
            if h is None:
                continue
            expected, seen = h["expected_direction"], r.directions.get(name, "unknown")
            trial["hypotheses"][name] = {"concept": h["concept"], "status": self._verdict(name in new, sign * trial["parent_delta"], r.importance.get(name), better / max(1, len(r.folds)), expected in ("unknown", seen))}

    @staticmethod
    def _verdict(new: bool, gain: float, importance: float | None, share: float, agrees: bool) -> str:
        if not new:
            return "retained"
        if gain <= 0:
            return "rejected"
        if not importance or importance <= 0 or not agrees:
            return "inconclusive"
        return "strongly_supported" if share >= 0.8 else "supported"
