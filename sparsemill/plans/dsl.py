"""The transform language: new=Function(namespace, ...)(number, ...).

Statements may come in any order. They are resolved by name in alphabetical order,
each after the transforms it reads, and numbered in that order: the number seeds a
transformed namespace's hashes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from ..sources.catalog import Catalog

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
STATEMENT = re.compile(rf"\s*({NAME})\s*=\s*({NAME})\s*\(\s*({NAME}(?:\s*,\s*{NAME})*)\s*\)\s*\(\s*([^()]*?)\s*\)")
#: Names of functions, and the namespaces that each takes.
BINNERS = {"BinnerSqrtPlain": ("sqrt", False), "BinnerSqrt": ("sqrt", True), "BinnerLogPlain": ("log", False), "BinnerLog": ("log", True)}
RATIOS = {"BinnerLogRatioPlain": False, "BinnerLogRatio": True}


class DslError(ValueError):
    pass


@dataclass(frozen=True)
class Transform:
    name: str
    function: str
    sources: tuple[str, ...]
    params: tuple[float, ...]
    index: int = -1
    statement: str = ""

    @property
    def column(self) -> str:
        return f"tx_{self.name}"


def parse_statement(text: str) -> Transform:
    """What follows the last parenthesis is ignored."""
    m = STATEMENT.match(text)
    if not m:
        raise DslError(f"Error parsing {text}")
    try:
        params = tuple(float(x) for x in m[4].split(",") if x.strip())
    except ValueError:
        raise DslError(f"Error parsing {text}") from None
    return Transform(m[1], m[2], tuple(x.strip() for x in m[3].split(",")), params, statement=text)


def _validate(t: Transform, catalog: Catalog, known: dict[str, Transform]) -> None:
    floats = [s for s in t.sources if (n := catalog.by_verbose(s)) is not None and n.is_float]
    if t.function in BINNERS or t.function in RATIOS:
        wanted = 1 if t.function in BINNERS else 2
        if len(t.params) > 2:
            raise DslError(f"Function {t.function} takes up to two float arguments, {len(t.params)} given, {t.params}")
        if t.params and t.params[0] < 0:
            raise DslError(f"Function {t.function} parameter greater_than cannot be negative: {t.params[0]}")
        if len(t.sources) != wanted:
            raise DslError(f"Function {t.function} takes exactly {wanted} namespace argument{'s' * (wanted > 1)}, {len(t.sources)} given")
        for s in t.sources:
            if s not in floats:
                raise DslError(f"All namespaces of function {t.function} have to be of type f32: From namespace ({s}) should be typed in {'vw_namespace_map.csv'}")
    elif t.function == "Combine":
        if t.params:
            raise DslError(f"Function {t.function} takes no float arguments {t.params}")
        if not 2 <= len(t.sources) <= 4:
            raise DslError(f"Function {t.function} takes between 2 and 4 namespaces  as arguments, {len(t.sources)} given")
    elif t.function == "Weight":
        if len(t.params) != 1:
            raise DslError(f"Function {t.function} takes exactly one float argument, {len(t.params)} given")
        if len(t.sources) != 1:
            raise DslError(f"Function {t.function} takes exactly one namespace argument, {len(t.sources)} given")
    else:
        raise DslError(f"Unknown transformer function: {t.function}")


def resolve(statements: Sequence[str], catalog: Catalog) -> list[Transform]:
    """The transforms in an order in which each one's sources stand before it."""
    given: dict[str, Transform] = {}
    for text in statements:
        t = parse_statement(text)
        if catalog.by_verbose(t.name):
            raise DslError(f'To namespace of {text} already exists as primitive namespace: "{t.name}"')
        if t.name in given:
            raise DslError(f'To namespace of {text} already exists: "{t.name}"')
        given[t.name] = t
    done: dict[str, Transform] = {}
    for root in sorted(given):
        path: list[tuple[str, int]] = [(root, 0)] if root not in done else []
        while path:
            name, at = path.pop()
            t = given[name]
            if at < len(t.sources):
                path.append((name, at + 1))
                source = t.sources[at]
                if catalog.by_verbose(source) is None and source not in done:
                    if source not in given:
                        raise DslError(f'Could not find namespace "{source}"')
                    if any(n == source for n, _ in path):
                        raise DslError(f'Cyclic dependency detected, one of the namespaces involved is "{source}"')
                    path.append((source, 0))
                continue
            for i, s in enumerate(t.sources):
                if s in t.sources[i + 1 :]:
                    raise DslError(f'Using the same from namespace in multiple arguments to a function is not supported: "{s}"')
            _validate(t, catalog, done)
            done[name] = Transform(t.name, t.function, t.sources, t.params, len(done), t.statement)
    return list(done.values())
