"""The trial ledger: a transactional store on the driver with one writer, readable as DataFrames."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import sqlite3
import time

from pyspark.sql import DataFrame, SparkSession


class LedgerLocked(RuntimeError):
    """Another process writes this ledger."""


class Ledger:
    """Trials and metadata as JSON by key; each save is one transaction."""

    def __init__(self, path: str):
        self.path = path
        with self._open() as db:
            db.execute("PRAGMA journal_mode=WAL")
            db.execute("CREATE TABLE IF NOT EXISTS trials (study TEXT, number INTEGER, record TEXT NOT NULL, PRIMARY KEY (study, number))")
            db.execute("CREATE TABLE IF NOT EXISTS studies (study TEXT PRIMARY KEY, record TEXT NOT NULL)")

    @contextlib.contextmanager
    def _open(self):
        db = sqlite3.connect(self.path, timeout=30)
        try:
            with db:
                yield db
        finally:
            db.close()

    @contextlib.contextmanager
    def lock(self):
        with open(f"{self.path}.lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise LedgerLocked(self.path) from None
            yield self

    def save(self, trial: dict, study: str = "default", meta: dict | None = None) -> None:
        with self._open() as db:
            db.execute("INSERT OR REPLACE INTO trials VALUES (?, ?, ?)", (study, trial["number"], json.dumps(trial, allow_nan=False)))
            if meta is not None:
                db.execute("INSERT OR REPLACE INTO studies VALUES (?, ?)", (study, json.dumps(meta, allow_nan=False)))

    def trials(self, study: str = "default") -> list[dict]:
        with self._open() as db:
            return [json.loads(x) for (x,) in db.execute("SELECT record FROM trials WHERE study = ? ORDER BY number", (study,))]

    def meta(self, study: str = "default") -> dict | None:
        with self._open() as db:
            row = db.execute("SELECT record FROM studies WHERE study = ?", (study,)).fetchone()
        return json.loads(row[0]) if row else None

    def archive(self, study: str) -> str:
        """Puts a study that no longer fits aside under a new name; nothing is lost."""
        name = f"{study}@{time.strftime('%Y%m%dT%H%M%S')}-{os.getpid()}"
        with self._open() as db:
            for table in ("trials", "studies"):
                db.execute(f"UPDATE {table} SET study = ? WHERE study = ?", (name, study))
        return name

    def view(self, spark: SparkSession, schema: str, study: str = "default") -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(x.get(n) for n in names) for x in self.trials(study)], schema)
