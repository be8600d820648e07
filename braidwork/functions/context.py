"""Immutable key-value context that travels with a sequence."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any


class Context(Mapping):
    def __init__(self, values: Mapping | None = None):
        self._values = dict(values or {})

    def __getitem__(self, key: Any) -> Any:
        return self._values[key]

    def __iter__(self) -> Iterator:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def put(self, key: Any, value: Any) -> Context:
        if key is None or value is None:
            raise ValueError("keys and values of a context are not None")
        return Context({**self._values, key: value})

    def put_all(self, other: Mapping) -> Context:
        return Context({**self._values, **other})

    def delete(self, key: Any) -> Context:
        return Context({k: v for k, v in self._values.items() if k != key})

    def has_key(self, key: Any) -> bool:
        return key in self._values

    def get_or_default(self, key: Any, default: Any) -> Any:
        return self._values.get(key, default)
