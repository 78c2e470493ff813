"""Pattern modules: what a pattern declares, the built-in ones, and a check of foreign ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pedigree.operators import provenance, publisher


@dataclass(frozen=True)
class PatternModule:
    """A named, versioned function from a release history to relations."""

    name: str
    version: int
    extract: Callable[..., dict[str, DataFrame]]
    requires: tuple[str, ...] = field(default=("history",))


def check(module: PatternModule) -> PatternModule:
    """The module itself, or an error that says what is wrong with it."""
    if not isinstance(module.name, str) or not module.name:
        raise ValueError("a pattern has a non-empty name")
    if not isinstance(module.version, int) or isinstance(module.version, bool) or module.version < 1:
        raise ValueError(f"a pattern's version is a positive integer, not {module.version!r}")
    if not isinstance(module.requires, (list, tuple)) or not all(isinstance(x, str) for x in module.requires):
        raise ValueError("a pattern requires a list of input names")
    if not callable(module.extract):
        raise ValueError("a pattern's extract is callable")
    return module


PATTERNS = {m.name: check(m) for m in (PatternModule("publisher", 1, publisher.extract), PatternModule("provenance", 1, provenance.extract))}
