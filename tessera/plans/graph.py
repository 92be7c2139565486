"""Feature sets as acyclic graphs: order, generations and hashes that don't depend on how a set was written down."""

from __future__ import annotations

import graphlib
import hashlib
import json
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from tessera.contracts import COMMUTATIVE, MAX_SET, SIGNATURES, STATEFUL, ContractError, Dataset, Feature, need

VERSION = "1"


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Node:
    feature: Feature
    generation: int
    expression: str
    content: str
    source_trial: int | None = None

    @property
    def stateful(self) -> bool:
        return self.feature.op in STATEFUL

    def fits(self, kinds: dict[str, str]) -> Node:
        """Itself, if its operator takes inputs of these kinds."""
        f = self.feature
        wrong = [f"{x} is {kinds[x]}, not {kind}" for x, kind in zip(f.inputs, SIGNATURES[f.op], strict=True) if kind not in ("any", kinds[x])]
        need(not wrong, f"{f.name} ({f.op}): {'; '.join(wrong)}")
        return self


@dataclass(frozen=True)
class Graph:
    dataset: Dataset
    nodes: tuple[Node, ...] = ()

    @classmethod
    def of(cls, dataset: Dataset, features, trials: dict[str, int] | None = None) -> Graph:
        """Features in any order; a cycle, a dangling or taken name, a wrong kind or a repeated expression is an error."""
        own = {f.name: f for f in features}
        need(len(own) == len(list(features)), "feature names must be unique")
        need(len(own) <= MAX_SET, f"at most {MAX_SET} features in a set")
        clash = sorted(own.keys() & {f.name for f in dataset.fields})
        need(not clash, f"names of fields: {clash}")
        dangling = sorted({x for f in own.values() for x in f.inputs} - own.keys() - {f.name for f in dataset.usable})
        need(not dangling, f"unknown inputs: {dangling}")
        try:
            order = [n for n in graphlib.TopologicalSorter({n: f.inputs for n, f in own.items()}).static_order() if n in own]
        except graphlib.CycleError as e:
            raise ContractError(f"cycle: {e.args[1]}") from None
        kinds = {f.name: f.dtype for f in dataset.usable} | {n: f.dtype for n, f in own.items()}
        generation = {f.name: 0 for f in dataset.usable}
        expression = {f.name: digest(["field", f.name, f.dtype]) for f in dataset.usable}
        content = dict(expression)
        nodes = []
        for n in order:
            f = own[n]
            params = {k: float(v) for k, v in f.params.items()}
            arranged = lambda table: (sorted if f.op in COMMUTATIVE else list)(table[x] for x in f.inputs)  # noqa: E731, B023
            generation[n] = 1 + max(generation[x] for x in f.inputs)
            expression[n] = digest({"version": VERSION, "op": f.op, "inputs": arranged(expression), "params": params})
            content[n] = digest({"version": VERSION, "name": n, "op": f.op, "inputs": arranged(content), "params": params})
            nodes.append(Node(f, generation[n], expression[n], content[n], (trials or {}).get(n)).fits(kinds))
        need(len({x.expression for x in nodes}) == len(nodes), "an expression repeats")
        return cls(dataset, tuple(sorted(nodes, key=lambda x: (x.generation, x.expression, x.feature.name))))

    @cached_property
    def hash(self) -> str:
        return digest(sorted(x.content for x in self.nodes))

    @property
    def features(self) -> tuple[Feature, ...]:
        return tuple(x.feature for x in self.nodes)

    def expression_of(self, name: str) -> str:
        return next((x.expression for x in self.nodes if x.feature.name == name), None) or digest(["field", name, next(f.dtype for f in self.dataset.usable if f.name == name)])

    def generations(self) -> list[list[Node]]:
        top = max((x.generation for x in self.nodes), default=0)
        return [[x for x in self.nodes if x.generation == g] for g in range(1, top + 1)]

    def leaves(self) -> list[str]:
        used = {x for f in self.features for x in f.inputs}
        return [f.name for f in self.features if f.name not in used]

    def records(self) -> list[dict]:
        return [n.feature.record() | {"dtype": n.feature.dtype, "stateful": n.stateful, "generation": n.generation, "expression_hash": n.expression, "content_hash": n.content, "source_trial": n.source_trial} for n in self.nodes]

    @classmethod
    def load(cls, dataset: Dataset, records: list[dict]) -> Graph:
        """Reads records back and refuses what was changed: each derived value must come out the same."""
        keys = ("name", "op", "inputs", "params", "hypothesis")
        graph = cls.of(dataset, [Feature(**{k: r[k] for k in keys}) for r in records], {r["name"]: r.get("source_trial") for r in records})
        found = {r["name"]: r for r in records}
        for r in graph.records():
            need(all(found[r["name"]].get(k, r[k]) == r[k] for k in ("dtype", "stateful", "generation", "expression_hash", "content_hash")), f"{r['name']}: stored record doesn't match its content")
        return graph
