"""Names: words of an identifier, written in other styles, and names that clash."""

from __future__ import annotations

import re

WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")


def words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def snake(name: str) -> str:
    lead = len(name) - len(name.lstrip("_"))
    return "_" * lead + "_".join(words(name))


def camel(name: str) -> str:
    lead = len(name) - len(name.lstrip("_"))
    first, *rest = words(name) or [""]
    return "_" * lead + first + "".join(w.capitalize() for w in rest)


def pascal(name: str) -> str:
    return "".join(w.capitalize() for w in words(name))


def kebab(name: str) -> str:
    return "-".join(words(name))


STYLES = {"snake": snake, "camel": camel, "pascal": pascal, "kebab": kebab, "upper": lambda n: snake(n).upper(), "lower": lambda n: "".join(words(n)), "title": lambda n: " ".join(w.capitalize() for w in words(n)), "dot": lambda n: ".".join(words(n)), "path": lambda n: "/".join(words(n)), "none": lambda n: n}


def written(name: str, style: str) -> str:
    return STYLES[style](name)


def clashes(names: list[str]) -> list[tuple[str, str]]:
    """Pairs of names that become one in snake case."""
    seen: dict[str, str] = {}
    out = []
    for n in names:
        key = snake(n)
        if key in seen and seen[key] != n:
            out.append((seen[key], n))
        seen.setdefault(key, n)
    return out
