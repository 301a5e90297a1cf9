"""Immutable query trees.

Inverted-list nodes give positions per document, scored nodes give a score per document. ``str`` of a node
is its canonical text; equal leaves of any queries have equal text and are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

FIELDS = ("body", "url", "keywords", "title", "inlink")


@dataclass(frozen=True)
class Node:
    """Any operator of a query."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class ListNode(Node):
    """Gives positions; all terms below it are of one field."""

    @property
    def field(self) -> str:
        return self.children()[0].field  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Term(ListNode):
    term: str
    in_field: str = "body"

    @property
    def field(self) -> str:
        return self.in_field

    def __str__(self) -> str:
        return f"{self.term}.{self.in_field}"


@dataclass(frozen=True)
class _Lists(ListNode):
    args: tuple[ListNode, ...]

    def children(self) -> tuple[Node, ...]:
        return self.args

    def _text(self, name: str) -> str:
        return f"#{name}( {' '.join(map(str, self.args))} )"


@dataclass(frozen=True)
class Syn(_Lists):
    def __str__(self) -> str:
        return self._text("SYN")


@dataclass(frozen=True)
class Near(_Lists):
    n: int = 1

    def __str__(self) -> str:
        return self._text(f"NEAR/{self.n}")


@dataclass(frozen=True)
class Window(_Lists):
    n: int = 1

    def __str__(self) -> str:
        return self._text(f"WINDOW/{self.n}")


@dataclass(frozen=True)
class Score(Node):
    """The score of a list under the retrieval model; put in by ``rules.analyze``."""

    list: ListNode

    def children(self) -> tuple[Node, ...]:
        return (self.list,)

    def __str__(self) -> str:
        return f"#SCORE( {self.list} )"


@dataclass(frozen=True)
class Scored(Node):
    args: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.args

    @property
    def name(self) -> str:
        return type(self).__name__.upper()

    def __str__(self) -> str:
        return f"#{self.name}( {' '.join(map(str, self.args))} )"


@dataclass(frozen=True)
class And(Scored):
    pass


@dataclass(frozen=True)
class Or(Scored):
    pass


@dataclass(frozen=True)
class Sum(Scored):
    pass


@dataclass(frozen=True)
class Weighted(Scored):
    weights: tuple[float, ...] = ()

    def __str__(self) -> str:
        return f"#{self.name}( {' '.join(f'{w:g} {a}' for w, a in zip(self.weights, self.args))} )"


@dataclass(frozen=True)
class WAnd(Weighted):
    pass


@dataclass(frozen=True)
class WSum(Weighted):
    pass
