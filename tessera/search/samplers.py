"""Where proposals come from: chance, recombination, a language model behind a transport, or a mix."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import urlparse

import numpy as np

from tessera.contracts import SIGNATURES, ContractError, Dataset, Feature, Hypothesis, Proposal
from tessera.plans.graph import Graph

TRIES = 100


@dataclass
class Context:
    dataset: Dataset
    parent: Graph
    number: int
    trials: list[dict]
    most: int = 2
    maximize: bool = True
    memory: dict[str, Any] = field(default_factory=dict)
    statistics: dict[str, Any] | Callable[[list[str]], dict[str, Any]] = field(default_factory=dict)
    columns: list[str] | None = None


class Sampler(Protocol):
    def sample(self, context: Context) -> Proposal: ...


def rng_of(seed: int, number: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, number]))


def fits(parent: Graph, new: list[Feature], feature: Feature) -> bool:
    try:
        Graph.of(parent.dataset, [*parent.features, *new, feature])
    except ContractError:
        return False
    return True


@dataclass
class RandomSampler:
    """Valid features by chance, a function of (seed, trial number) alone. May return fewer than asked for."""

    seed: int = 0

    def sample(self, context: Context) -> Proposal:
        rng, new = rng_of(self.seed, context.number), []
        kinds = {f.name: f.dtype for f in context.dataset.usable} | {f.name: f.dtype for f in context.parent.features}
        operators = [op for op in SIGNATURES if op != "clip"]
        for slot in range(context.most):
            for _ in range(TRIES):
                op = operators[rng.integers(len(operators))]
                inputs = []
                for kind in SIGNATURES[op]:
                    choices = [n for n, k in kinds.items() if kind in ("any", k) and not (op in ("subtract", "divide", "days_between", "cross") and n in inputs)]
                    if not choices:
                        break
                    inputs.append(choices[rng.integers(len(choices))])
                if len(inputs) < len(SIGNATURES[op]):
                    continue
                f = Feature(f"f{context.number}_{slot}", op, tuple(inputs), hypothesis=Hypothesis(op, f"{op} of {' and '.join(inputs)}"))
                if fits(context.parent, new, f):
                    new.append(f)
                    kinds[f.name] = f.dtype
                    break
        return Proposal(tuple(new))


@dataclass
class EvolutionSampler:
    """Even trials take up a feature of the five best trials that the parent lacks; odd ones are random."""

    seed: int = 0

    def sample(self, context: Context) -> Proposal:
        if context.number % 2 == 0:
            done = [t for t in context.trials if t["state"] == "COMPLETE" and t.get("value") is not None]
            for t in sorted(done, key=lambda t: (-t["value"] if context.maximize else t["value"], t["number"]))[:5]:
                for record in t["features"]:
                    f = Feature(f"f{context.number}_0", record["op"], tuple(record["inputs"]), record["params"], Hypothesis(**record["hypothesis"]) if record.get("hypothesis") else None)
                    if fits(context.parent, [], f):
                        return Proposal((f,))
        return RandomSampler(self.seed).sample(context)


def strict_json(text: str) -> Any:
    """One JSON value, in a fence or not; repeated keys and NaN are errors."""
    fenced = re.fullmatch(r"\s*```(?:json)?\s*\n(.*?)\n\s*```\s*", text, re.S)

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ContractError("repeated key in reply")
        return dict(items)

    def refuse(x):
        raise ContractError(f"{x} in reply")

    try:
        return json.loads(fenced[1] if fenced else text, object_pairs_hook=pairs, parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise ContractError(f"reply is not JSON: {e.msg}") from None


def prompt(context: Context, most_bytes: int = 12_000, most_columns: int = 20) -> str:
    """What a model is told: the contract and bounded summaries, never rows or labels. Parts go in a fixed order until it fits."""
    picked = [f for f in context.dataset.usable if context.columns is None or f.name in context.columns][:most_columns]
    parts: dict[str, Any] = {
        "task": {"objective": context.dataset.objective, "target": context.dataset.target_definition, "prediction_point": context.dataset.prediction_point, "guidance": context.dataset.search_guidance},
        "operators": {k: list(v) for k, v in SIGNATURES.items()},
        "limits": {"features": context.most},
        "columns": [{"name": f.name, "dtype": f.dtype, "description": f.description, "unit": f.unit, "tags": list(f.semantic_tags)} for f in picked],
        "current": [f.record() for f in context.parent.features],
        "memory": context.memory,
        "statistics": context.statistics([f.name for f in picked]) if callable(context.statistics) else {k: v for k, v in context.statistics.items() if k in {f.name for f in picked}},
    }
    size = lambda: len(json.dumps(parts, ensure_ascii=False).encode())
    for key in ("statistics", "memory", "current"):
        if size() > most_bytes:
            parts[key] = {} if isinstance(parts[key], dict) else []
    while size() > most_bytes and parts["columns"]:
        parts["columns"].pop()
    if size() > most_bytes:
        raise ContractError("the prompt's fixed part passes its bound")
    return json.dumps(parts, ensure_ascii=False)


Transport = Callable[[str, dict[str, str], bytes], tuple[int, bytes]]


def http(url: str, headers: dict[str, str], body: bytes) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as reply:  # noqa: S310
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:  # a reply too, which the client judges by its status
        return e.code, e.read()


@dataclass
class Client:
    """A chat endpoint. Plain http only on this machine; busy replies (429, 502, 503, 504) are tried again, failed transports aren't.

    Tokens without a report count as unknown, and a cost with unknown parts is None.
    """

    url: str
    model: str
    key: str = field(default="", repr=False)
    transport: Transport = http
    most_bytes: int = 60_000
    attempts: int = 3
    price: tuple[float, float] | None = None
    requests: int = 0
    unknown: int = 0
    tokens: list[int] = field(default_factory=lambda: [0, 0])

    def __post_init__(self):
        at = urlparse(self.url)
        if at.scheme != "https" and at.hostname not in ("localhost", "127.0.0.1", "::1"):
            raise ContractError("the endpoint must use https")

    def ask(self, messages: list[dict[str, str]]) -> str:
        body = json.dumps({"model": self.model, "messages": messages}).encode()
        if len(body) > self.most_bytes:
            raise ContractError("the request passes its byte bound")
        for attempt in range(self.attempts):
            self.requests += 1
            self.unknown += 1  # until a report says otherwise
            status, raw = self.transport(self.url, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}, body)
            if status in (429, 502, 503, 504) and attempt + 1 < self.attempts:
                continue
            if status != 200:
                raise ContractError(f"the endpoint replied {status}")
            reply = strict_json(raw.decode())
            usage = reply.get("usage") or {}
            if isinstance(usage.get("prompt_tokens"), int) and isinstance(usage.get("completion_tokens"), int):
                self.unknown -= 1
                self.tokens[0] += usage["prompt_tokens"]
                self.tokens[1] += usage["completion_tokens"]
            return reply["choices"][0]["message"]["content"]
        raise ContractError("the endpoint stays busy")

    @property
    def cost(self) -> float | None:
        return None if self.unknown or self.price is None else sum(n * p for n, p in zip(self.tokens, self.price, strict=True)) / 1e6


@dataclass
class ModelSampler:
    """Proposals of a language model; replies that break the contract are sent back with the error only, up to ``repairs`` times."""

    client: Client
    repairs: int = 2

    def sample(self, context: Context) -> Proposal:
        messages = [{"role": "system", "content": "Reply with one JSON object: features (name, op, inputs, params, hypothesis), remove, model_params."}, {"role": "user", "content": prompt(context)}]
        for k in range(self.repairs + 1):
            try:
                p = Proposal.parse(strict_json(self.client.ask(messages)))
                known = context.columns
                if known is not None and any(x not in known and x not in {f.name for f in (*p.features, *context.parent.features)} for f in p.features for x in f.inputs):
                    raise ContractError("inputs must be among the columns shown")
                Graph.of(context.dataset, [*(f for f in context.parent.features if f.name not in p.remove), *p.features])
                return p
            except ContractError as e:
                if k == self.repairs:
                    raise
                messages = [*messages[:2], {"role": "user", "content": f"The last reply was refused: {str(e)[:300]}"}]
        raise AssertionError


@dataclass
class HybridSampler:
    first: Sampler
    other: Sampler
    every: int = 3

    def sample(self, context: Context) -> Proposal:
        return (self.first if (context.number - 1) % self.every == 0 else self.other).sample(context)


@dataclass
class AutonomousSampler:
    """One feature at a time; every so often, or when full, the last leaf whose removal is untried goes."""

    inner: Sampler
    remove_every: int = 4
    capacity: int = 64

    def sample(self, context: Context) -> Proposal:
        tried = {tuple(t.get("removed") or ()) for t in context.trials if t.get("parent_hash") == context.parent.hash}
        leaves = [x for x in context.parent.leaves() if (x,) not in tried]
        full = len(context.parent.nodes) >= self.capacity
        if leaves and (full or context.number % self.remove_every == 0):
            return Proposal(remove=(leaves[-1],))
        context.most = 1
        p = self.inner.sample(context)
        return Proposal(p.features[:1], p.remove, p.model_params)
