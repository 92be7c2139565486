"""Results of evaluations kept by content, in memory or as files, so that studies of the same data share them."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from typing import Any

from tessera.contracts import need
from tessera.plans.graph import digest

#: Results that memory holds at most; files have no bound.
ENTRIES = 1024


class Artifacts:
    """Plain values by (space, key). A space is a fingerprint of data and contract; a key is anything that JSON can hold.

    With a folder (on the driver, beside the ledger) values outlive the
    process; a file appears whole or not at all. A damaged file is an error,
    not a miss.
    """

    def __init__(self, folder: str | None = None):
        self.folder, self.held = folder, OrderedDict()
        self.hits = self.misses = 0

    def _path(self, space: str, name: str) -> str:
        need(space.isalnum(), "a space is a fingerprint")
        return os.path.join(self.folder, space, f"{name}.json")

    def get(self, space: str, key: Any) -> Any | None:
        name, found = digest(key), None
        if self.folder:
            path = self._path(space, name)
            if os.path.exists(path):
                with open(path) as f:
                    found = json.load(f)
        elif (text := self.held.get((space, name))) is not None:
            self.held.move_to_end((space, name))
            found = json.loads(text)
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def put(self, space: str, key: Any, value: Any) -> None:
        name, text = digest(key), json.dumps(value, allow_nan=False)
        if not self.folder:
            self.held[space, name] = text
            while len(self.held) > ENTRIES:
                self.held.popitem(last=False)
            return
        path = self._path(space, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            f.write(text)
        os.replace(part, path)
