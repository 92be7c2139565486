"""An offline HTML report of a study: tables and inline charts, all text escaped."""

from __future__ import annotations

import html
import os
import tempfile


def table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda x: html.escape("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{cell(r.get(c))}</td>' for c in columns) + '</tr>' for r in rows)}</table>"


def line_chart(points: list[tuple[float, float]], title: str, width: int = 480, height: int = 160) -> str:
    if not points:
        return f"<p>{html.escape(title)}: no data</p>"
    xs, ys = zip(*points, strict=True)
    place = lambda v, lo, hi, size: 20 + (size - 40) * ((v - lo) / (hi - lo) if hi > lo else 0.5)
    path = " ".join(f"{place(x, min(xs), max(xs), width):.1f},{height - place(y, min(ys), max(ys), height):.1f}" for x, y in points)
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg width="{width}" height="{height}" role="img"><polyline fill="none" stroke="#2563eb" stroke-width="2" points="{path}"/></svg></figure>'


def bars(values: dict[str, float], title: str, most: int = 20) -> str:
    top = sorted(values.items(), key=lambda x: (-x[1], x[0]))[:most]
    peak = max((abs(v) for _, v in top), default=0) or 1
    rows = "".join(f'<text x="4" y="{16 * k + 12}" font-size="11">{html.escape(n)}</text><rect x="200" y="{16 * k + 3}" width="{250 * abs(v) / peak:.1f}" height="10" fill="#2563eb"/>' for k, (n, v) in enumerate(top))
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg width="480" height="{16 * len(top) + 8}" role="img">{rows}</svg></figure>'


def render(name: str, trials: list[dict], maximize: bool = True) -> str:
    done = [t for t in trials if t["state"] == "COMPLETE"]
    best, curve = None, []
    for t in done:
        best = t["value"] if best is None else (max if maximize else min)(best, t["value"])
        curve.append((t["number"], best))
    top = (max if maximize else min)(done, key=lambda t: t["value"], default=None)
    spent, fits = 0, []
    for t in trials:
        spent += t["fits"]
        fits.append((t["number"], spent))
    hypotheses = [{"trial": t["number"], "feature": k, **v} for t in trials for k, v in t["hypotheses"].items()]
    parts = [
        f"<h1>{html.escape(name)}</h1>", line_chart(curve, "Best value by trial"), line_chart([(t["number"], t["value"]) for t in done], "Value by trial"), line_chart(fits, "Model fits by trial"), line_chart([(t["number"], t["duration"]) for t in trials], "Seconds by trial"),
        bars(top["importance"] if top else {}, "Importance in the best trial"), "<h2>Trials</h2>", table(trials, ["number", "state", "value", "delta", "parent", "parent_delta", "fits", "duration", "error"]),
        "<h2>Features of the best trial</h2>", table(top["features"] if top else [], ["name", "op", "inputs", "params", "generation", "source_trial"]), "<h2>Hypotheses</h2>", table(hypotheses, ["trial", "feature", "concept", "status"]),
    ]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(name)}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{border:1px solid #ccc;padding:2px 6px}}table{{border-collapse:collapse}}</style></head><body>{''.join(parts)}</body></html>"


def write(path: str, text: str) -> None:
    """All or nothing: written beside its place and renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
