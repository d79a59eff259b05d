"""Parsed queries: one basic graph pattern under a SELECT."""

from __future__ import annotations

from dataclasses import dataclass, field


class SparqlSyntaxError(ValueError):
    """The text is not a SPARQL query."""


class UnsupportedSparqlError(ValueError):
    """A SPARQL query, but more than a SELECT over one basic graph pattern."""


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Pattern:
    """Each place is a Var or a term in lexical form."""

    s: Var | str
    p: Var | str
    o: Var | str

    @property
    def places(self) -> tuple:
        return (self.s, self.p, self.o)

    @property
    def variables(self) -> tuple[str, ...]:
        """Names, each once, in the order of their places."""
        return tuple(dict.fromkeys(x.name for x in self.places if isinstance(x, Var)))

    @property
    def bitmap(self) -> int:
        """Which places are variable: subject 4, predicate 2, object 1."""
        return sum(w for w, x in zip((4, 2, 1), self.places) if isinstance(x, Var))

    def __str__(self) -> str:
        return " ".join(map(str, self.places))


@dataclass(frozen=True)
class Query:
    select: tuple[str, ...]
    patterns: tuple[Pattern, ...]
    prefixes: dict[str, str] = field(default_factory=dict, compare=False)

    def __str__(self) -> str:
        head = " ".join(f"?{v}" for v in self.select)
        return f"SELECT {head} WHERE {{ " + " . ".join(map(str, self.patterns)) + " }"
