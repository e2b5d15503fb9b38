"""The verdict of a grammar on one text: valid, wrong at a token, or truncated."""

from __future__ import annotations

from typing import NamedTuple

from codestrata.llm.derivatives import parse, parse_with_insertion
from codestrata.llm.grammars import grammar
from codestrata.llm.lexers import tokens

LANGUAGES = ("python", "javascript", "typescript", "java", "go", "json", "yaml", "toml")
_EAGER = frozenset(["++", "--"])


class Fault(NamedTuple):
    kind: str
    """``token``: the derivative by a token is empty; ``end``: the derivative at the end is not nullable."""
    line: int
    column: int
    token: str


def fault(language: str, text: str) -> Fault | None:
    """What is wrong with ``text``; None if it is valid."""
    g = grammar(language)
    g.tidy()
    t = tokens(language, text)
    if t.fresh is not None:
        at = parse_with_insertion(g, t.kinds, t.fresh, "ASI", _EAGER, "}")
    else:
        at = parse(g, t.kinds)
    if at is None:
        return None
    ended = at >= len(t.kinds)
    place = len(text) if ended else t.places[at]
    line = text.count("\n", 0, place) + 1
    return Fault("end" if ended else "token", line, place - text.rfind("\n", 0, place), "" if ended else text[place : place + 40].split("\n")[0])
