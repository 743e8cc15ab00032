"""A memory of what a worker has worked out, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Bytes held at most, in two generations of half as many.
BYTES = 96 << 20
#: Longer keys are worked out each time: they seldom come back.
LONGEST = 64
#: What an entry takes beside its key and value.
EACH = 200


class Memo(dict):
    """key -> ``make(key)``.  When half the bytes are new, the entries that were
    not used since the last time are forgotten."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        super().__init__()
        self.make = make
        self.older: dict[str, Any] = {}
        self.bytes = 0

    def __missing__(self, key: str) -> Any:
        if len(key) > LONGEST:
            return self.make(key)
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        size = EACH + 4 * len(key) + (len(found) if isinstance(found, bytes) else 8 * len(found) if isinstance(found, tuple) else 8)
        if self.bytes + size > BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = found
        self.bytes += size
        return found
