"""Memoised parsing with derivatives.

The derivative of a language by a token is the language of what may follow that token. A grammar here is a
set of symbols (tokens, sequences, choices, repetitions, rules); a state is a sum of continuations, each a
stack of symbols still to be matched, and the derivative of a state is the sum of the derivatives of its
continuations (Antimirov's partial derivatives, which need no simplification of nullable parts). Everything is
hash-consed: equal stacks and equal states are one object, which remembers its derivatives by token. Files of
one language share their contexts, so nearly every step is one dictionary look-up, and parsing behaves like
an automaton that is built as far as the corpus needs it.

The state becomes empty exactly at the first token that no valid text can have there; a state that is not
empty but not nullable at the end of the tokens is that of a truncated text. Any context-free grammar without
left recursion will do, ambiguous ones included.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Stacks kept before the tables are emptied (a bound on memory, not on what can be parsed).
MAX_STACKS = 80_000


class Stack:
    __slots__ = ("memo", "nullable", "rest", "symbol")

    def __init__(self, symbol: int, rest: Stack | None, nullable: bool):
        self.symbol, self.rest, self.nullable, self.memo = symbol, rest, nullable, {}


class State:
    __slots__ = ("memo", "nullable", "stacks")

    def __init__(self, stacks: tuple[Stack, ...]):
        self.stacks = stacks
        self.nullable = any(s.nullable for s in stacks)
        self.memo: dict[str, State] = {}


class Grammar:
    """A grammar in a small notation, one rule to a line or indented lines::

        list: '[' (item (',' item)*)? ']'
        item: NUM | list

    Quoted words are tokens of that text, words in capitals token classes, others rules; ``? * +`` follow what
    they apply to. Rules are symbols by name; ``start`` is where parsing begins.
    """

    def __init__(self, text: str, start: str):
        self._kinds: list[tuple] = []
        self._ids: dict[tuple, int] = {}
        self._rules: dict[str, int] = {}
        self._bodies: dict[int, int] = {}
        self._read(text)
        missing = [r for r in self._rules if self._rules[r] not in self._bodies]
        if missing:
            raise ValueError(f"rules without a body: {missing}")
        self._nullable = self._find_nullable()
        self._first: dict[tuple[int, str], tuple[tuple[int, ...], ...]] = {}
        self._busy: set[tuple[int, str]] = set()
        self._start = self._rules[start]
        self.reset()

    # ---- notation ----

    def _symbol(self, *key) -> int:
        if key not in self._ids:
            self._ids[key] = len(self._kinds)
            self._kinds.append(key)
        return self._ids[key]

    def _rule(self, name: str) -> int:
        if name not in self._rules:
            self._rules[name] = self._symbol("rule", name)
        return self._rules[name]

    def _read(self, text: str) -> None:
        joined: list[str] = []
        for line in text.split("\n"):
            if not line.strip() or line.lstrip().startswith("##"):
                continue
            if line[0].isspace() and joined:
                joined[-1] += " " + line.strip()
            else:
                joined.append(line.strip())
        for line in joined:
            name, _, body = line.partition(":")
            tokens = re.findall(r"'(?:[^'\\]|\\.)+'|[A-Za-z_][A-Za-z_0-9]*|[()|?*+]", body)
            symbol, at = self._choice(tokens, 0)
            if at != len(tokens):
                raise ValueError(f"cannot read {line!r} at {tokens[at:at + 4]}")
            rule = self._rule(name.strip())
            if rule in self._bodies:
                raise ValueError(f"two bodies for {name}")
            self._bodies[rule] = symbol

    def _choice(self, tokens: list[str], at: int) -> tuple[int, int]:
        options = []
        symbol, at = self._sequence(tokens, at)
        options.append(symbol)
        while at < len(tokens) and tokens[at] == "|":
            symbol, at = self._sequence(tokens, at + 1)
            options.append(symbol)
        return (options[0] if len(options) == 1 else self._symbol("alt", *options)), at

    def _sequence(self, tokens: list[str], at: int) -> tuple[int, int]:
        parts = []
        while at < len(tokens) and tokens[at] not in ("|", ")"):
            token = tokens[at]
            at += 1
            if token == "(":
                symbol, at = self._choice(tokens, at)
                at += 1
            elif token[0] == "'":
                symbol = self._symbol("tok", re.sub(r"\\(.)", r"\1", token[1:-1]))
            elif token.isupper() or token[0].isupper():
                symbol = self._symbol("tok", token)
            else:
                symbol = self._rule(token)
            while at < len(tokens) and tokens[at] in ("?", "*", "+"):
                if tokens[at] == "?":
                    symbol = self._symbol("alt", symbol, self._symbol("seq"))
                elif tokens[at] == "*":
                    symbol = self._symbol("star", symbol)
                else:
                    symbol = self._symbol("seq", symbol, self._symbol("star", symbol))
                at += 1
            parts.append(symbol)
        return (parts[0] if len(parts) == 1 else self._symbol("seq", *parts)), at

    def _find_nullable(self) -> list[bool]:
        out = [k[0] == "star" for k in self._kinds]
        changed = True
        while changed:
            changed = False
            for i, key in enumerate(self._kinds):
                if out[i]:
                    continue
                kind = key[0]
                if (
                    (kind == "seq" and all(out[s] for s in key[1:]))
                    or (kind == "alt" and any(out[s] for s in key[1:]))
                    or (kind == "rule" and out[self._bodies[i]])
                ):
                    out[i] = changed = True
        return out

    # ---- derivatives ----

    def reset(self) -> None:
        """Forget all stacks and states."""
        self._stacks: dict[tuple[int, int], Stack] = {}
        self._bottom = Stack(-1, None, True)
        self._states: dict[frozenset[int], State] = {}
        self.empty = self._state(())
        self.start = self._state((self._push((self._start,), self._bottom),))

    def _state(self, stacks: Iterable[Stack]) -> State:
        unique = {id(s): s for s in stacks}
        key = frozenset(unique)
        got = self._states.get(key)
        if got is None:
            got = self._states[key] = State(tuple(unique.values()))
        return got

    def _push(self, symbols: tuple[int, ...], rest: Stack) -> Stack:
        for symbol in reversed(symbols):
            key = (symbol, id(rest))
            got = self._stacks.get(key)
            if got is None:
                got = self._stacks[key] = Stack(symbol, rest, self._nullable[symbol] and rest.nullable)
            rest = got
        return rest

    def first(self, symbol: int, token: str) -> tuple[tuple[int, ...], ...]:
        """What may remain of ``symbol`` after ``token``: its derivative as a sum of sequences."""
        at = (symbol, token)
        got = self._first.get(at)
        if got is not None:
            return got
        if at in self._busy:
            raise ValueError(f"left recursion through {self._kinds[symbol]}")
        self._busy.add(at)
        key = self._kinds[symbol]
        kind = key[0]
        out: dict[tuple[int, ...], None] = {}
        if kind == "tok":
            if key[1] == token:
                out[()] = None
        elif kind == "rule":
            out = dict.fromkeys(self.first(self._bodies[symbol], token))
        elif kind == "alt":
            for s in key[1:]:
                out.update(dict.fromkeys(self.first(s, token)))
        elif kind == "star":
            out = dict.fromkeys((*rest, symbol) for rest in self.first(key[1], token))
        else:
            for i, s in enumerate(key[1:], 1):
                out.update(dict.fromkeys((*rest, *key[i + 1 :]) for rest in self.first(s, token)))
                if not self._nullable[s]:
                    break
        self._busy.discard(at)
        got = self._first[at] = tuple(out)
        return got

    def _of_stack(self, stack: Stack, token: str) -> tuple[Stack, ...]:
        found: list[Stack] = []
        walked = []
        while True:
            got = stack.memo.get(token)
            if got is not None:
                found.extend(got)
                break
            if stack.symbol < 0:
                break
            here = [self._push(seq, stack.rest) for seq in self.first(stack.symbol, token)]
            walked.append((stack, len(found)))
            found.extend(here)
            if not self._nullable[stack.symbol]:
                break
            stack = stack.rest
        for stack, at in walked:
            stack.memo[token] = tuple(found[at:])
        return tuple(found)

    def derive(self, state: State, token: str) -> State:
        """The derivative of a state by a token."""
        got = state.memo.get(token)
        if got is None:
            out: list[Stack] = []
            for stack in state.stacks:
                out.extend(self._of_stack(stack, token))
            got = state.memo[token] = self._state(out)
        return got

    def tidy(self) -> None:
        """Between two texts: empty the tables if they have grown too large."""
        if len(self._stacks) > MAX_STACKS or len(self._states) > MAX_STACKS:
            self.reset()


def parse(grammar: Grammar, tokens: list[str]) -> int | None:
    """Index of the failing token; ``len(tokens)`` if the text stops too early; None if it is valid."""
    state, empty, derive = grammar.start, grammar.empty, grammar.derive
    for i, token in enumerate(tokens):
        got = state.memo.get(token)
        state = derive(state, token) if got is None else got
        if state is empty:
            return i
    return None if state.nullable else len(tokens)


def parse_with_insertion(grammar: Grammar, tokens: list[str], fresh: list[bool], inserted: str, eager: frozenset[str], closing: str) -> int | None:
    """``parse`` where the token ``inserted`` may be supplied by the rules for automatic semicolons.

    It is supplied before a token that cannot follow, if that token is the first of its line or ``closing``,
    and at the end; before the first token of a line in ``eager`` wherever it is allowed.
    """
    state, empty, derive = grammar.start, grammar.empty, grammar.derive
    for i, token in enumerate(tokens):
        if fresh[i] and token in eager:
            other = derive(state, inserted)
            if other is not empty:
                other = derive(other, token)
                if other is not empty:
                    state = other
                    continue
        got = state.memo.get(token)
        after = derive(state, token) if got is None else got
        if after is empty:
            if fresh[i] or token == closing:
                after = derive(derive(state, inserted), token)
            if after is empty:
                return i
        state = after
    if state.nullable or derive(state, inserted).nullable:
        return None
    return len(tokens)
