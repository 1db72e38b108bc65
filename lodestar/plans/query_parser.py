"""A small search syntax, parsed on the driver.

Bare terms are optional, `+term` and `AND` make them required, `-term` and
`NOT` forbid them, quotes make a phrase. A syntax error gives an empty query,
and an empty query matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PIECE = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


@dataclass(frozen=True)
class Clause:
    """A word or phrase; occur is `should`, `must` or `must_not`."""

    occur: str
    text: str
    quoted: bool = False


@dataclass
class ParsedQuery:
    clauses: list[Clause] = field(default_factory=list)

    def _words(self, occur: str) -> list[str]:
        return [c.text for c in self.clauses if c.occur == occur and not c.quoted]

    @property
    def should(self) -> list[str]:
        return self._words("should")

    @property
    def must(self) -> list[str]:
        return self._words("must")

    @property
    def must_not(self) -> list[str]:
        return self._words("must_not")

    @property
    def phrases(self) -> list[str]:
        """Quoted phrases that aren't forbidden."""
        return [c.text for c in self.clauses if c.quoted and c.occur != "must_not"]

    @property
    def empty(self) -> bool:
        return all(c.occur == "must_not" for c in self.clauses)


def parse(text: str | None) -> ParsedQuery:
    out = ParsedQuery()
    text = text or ""
    if text.count('"') % 2:
        return out
    pieces = [(sign, quoted is not None, quoted if quoted is not None else word) for sign, quoted, word in (m.groups() for m in _PIECE.finditer(text))]
    operator = lambda i, name: 0 <= i < len(pieces) and pieces[i] == ("", False, name)
    for i, (sign, quoted, what) in enumerate(pieces):
        if not quoted:
            if sign == "" and what in ("AND", "OR", "NOT"):
                continue
            what = what.strip("()")
        if not what.strip():
            continue
        if sign == "-" or operator(i - 1, "NOT"):
            occur = "must_not"
        elif sign == "+" or operator(i - 1, "AND") or operator(i + 1, "AND"):
            occur = "must"
        else:
            occur = "should"
        out.clauses.append(Clause(occur, what, quoted))
    return out
