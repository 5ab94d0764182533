"""Driver-side helpers around tools: a registry of callables by namespaced name, and a cache with expiry."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any


def unwrap(raw: Any) -> Any:
    """A tool's answer: JSON text is parsed, and an object with the single key result gives that value. Doing it twice does no harm."""
    if isinstance(raw, str) and raw.strip()[:1] in ("{", "["):
        try:
            raw = json.loads(raw)
        except json.JSONDecodeError:
            return raw
    return raw["result"] if isinstance(raw, dict) and list(raw) == ["result"] else raw


class Tools:
    """Servers by name, each made on first use; a call names server.tool."""

    def __init__(self, servers: dict[str, Callable[[], dict[str, Callable[..., Any]]]]) -> None:
        self._make, self._made = dict(servers), {}

    def _server(self, name: str) -> dict[str, Callable[..., Any]]:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def names(self) -> list[str]:
        """All tools; servers that can't be made are left out."""
        found = []
        for server in sorted(self._make):
            try:
                found += [f"{server}.{tool}" for tool in sorted(self._server(server))]
            except OSError:
                continue
        return found

    def call(self, name: str, **args: Any) -> Any:
        server, _, tool = name.partition(".")
        if server not in self._make or tool not in self._server(server):
            raise KeyError(f"no tool {name}")
        return unwrap(self._server(server)[tool](**args))


class Expiring:
    """Results by key for a time."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self._seconds, self._clock, self._kept = seconds, clock, {}

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        now = self._clock()
        at, value = self._kept.get(key, (None, None))
        if at is None or now - at >= self._seconds:
            value = make()
            self._kept[key] = (now, value)
        return value
