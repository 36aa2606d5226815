"""Texts with parameters, read once and bound many times."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from ..errors import BindError
from ..functions import values as V
from . import ast as A
from .parser import parse_aggregate, parse_filter
from .patterns import python_pattern


class Params(dict):
    """Values by parameter name; ``set`` returns the params themselves, so calls chain."""

    def set(self, name: str, value: Any) -> Params:
        self[name] = V.checked(value)
        return self

    def names(self) -> list[str]:
        return sorted(self)

    def only(self, names: Iterable[str]) -> Params:
        """Those of the given names, for one of several texts that share params."""
        wanted = set(names)
        return Params({k: v for k, v in self.items() if k in wanted})

    def unused(self, *templates: Template) -> list[str]:
        """Names that none of the templates has."""
        known = {n for t in templates for n in t.params}
        return [n for n in self.names() if n not in known]


def _holes(tree: Any) -> Iterator[A.Param]:
    """The parameters of a tree, in the order of its text."""
    if isinstance(tree, A.Param):
        yield tree
    elif isinstance(tree, tuple):
        for x in tree:
            yield from _holes(x)
    elif A.is_dataclass(tree) and not isinstance(tree, type):
        for f in A.fields(tree):
            yield from _holes(getattr(tree, f.name))


class Template:
    """A filter's or an aggregate's text with parameters like ``:name``."""

    def __init__(self, text: str, tree: Any):
        self.text, self.tree = text, tree
        self.params = list(dict.fromkeys(p.name for p in _holes(tree)))

    @classmethod
    def filter(cls, text: str) -> Template:
        return cls(text, parse_filter(text))

    @classmethod
    def aggregate(cls, text: str) -> Template:
        return cls(text, parse_aggregate(text))

    def bind(self, params: dict[str, Any] | None = None, **more: Any) -> Any:
        """The filter or aggregate with the values in place; missing, unused and unfit values are BindErrors."""
        found = A.bind(self.tree, {**(params or {}), **more})
        for x in A.walk(found):
            if isinstance(x, A.Matches):
                try:
                    python_pattern(x.pattern)
                except Exception as e:
                    raise BindError(str(e)) from e
        return found

    def __repr__(self) -> str:
        return f"Template({self.text!r})"


__all__ = ["Params", "Template"]
