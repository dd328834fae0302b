"""Named plug-ins: parsers, filters, metrics, advantages, converters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Registry:
    """Functions by name; a name can't be given to a second function unless `replace` is set."""

    def __init__(self, kind: str, replace: bool = False) -> None:
        self.kind, self.replace = kind, replace
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            if not self.replace and self._known.get(name, f) is not f:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._known[name] = f
            return f

        return put

    def get(self, name: str) -> Callable[..., Any]:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {sorted(self._known)}")
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))

    def run_all(self, *args: Any) -> dict[str, Any]:
        """Every function's result; one that fails yields its error and doesn't stop the rest."""
        out: dict[str, Any] = {}
        for name in self:
            try:
                out[name] = self._known[name](*args)
            except Exception as e:  # noqa: BLE001  a plug-in's fault stays its own
                out[name] = e
        return out
