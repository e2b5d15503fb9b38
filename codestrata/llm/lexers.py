"""Token streams for the grammars: lists of token kinds with their places in the text.

Every lexer reads a whole text. What cannot be a token becomes ERROR, which no grammar has, so that the
derivative by it is empty. White space and comments give no tokens but for what they mean: line ends and
indentation in Python, line ends in Go and TOML, the first token of a line in JavaScript, structure in YAML.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from codestrata.llm.grammars import KEYWORDS


class Tokens(NamedTuple):
    kinds: list[str]
    places: list[int]
    fresh: list[bool] | None = None
    """For languages with automatic semicolons: whether a token is the first of its line."""


# ---- JSON ----

_JSON = re.compile(
    r"(?P<skip>[ \t\r\n]+)|(?P<STR>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(?P<word>(?:true|false|null)\b)|(?P<punct>[{}\[\]:,])|(?P<ERROR>[\s\S])",
    re.A,
)


def json_tokens(text: str) -> Tokens:
    kinds, places = [], []
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        kinds.append(m[0] if kind in ("punct", "word") else kind)
        places.append(m.start())
        if kind == "ERROR":
            break
    return Tokens(kinds, places)


# ---- TOML ----

_TOML_SKIP = re.compile(r"(?:[ \t]|#[^\x00-\x08\x0a-\x1f\x7f]*)*")
_TOML_NL = re.compile(r"\r?\n")
_TOML_BASIC = re.compile(r"\"(?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"")
_TOML_LITERAL = re.compile(r"'[^'\x00-\x08\x0a-\x1f\x7f]*'")
_TOML_ML = re.compile(
    r"\"\"\"(?:[^\"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|\"{1,2}(?!\"))*\"{3,5}|'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*'{3,5}"
)
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+")
_TOML_SCALAR = re.compile(
    r"(?:\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})?)?|\d{2}:\d{2}:\d{2}(?:\.\d+)?|true|false|[+-]?(?:inf|nan)"
    r"|0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w.+-])",
    re.A,
)


def toml_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    at, n = 0, len(text)
    inside: list[str] = []  # '[' array, '{' inline table, 'h' header
    value = False  # a value is due
    line_start = True
    while True:
        at = _TOML_SKIP.match(text, at).end()
        if at >= n:
            break
        places.append(at)
        c = text[at]
        m = _TOML_NL.match(text, at)
        if m:
            kinds.append("NL")
            at = m.end()
            line_start = not inside
            if not inside or inside[-1] != "[":
                value = False
            continue
        if value:
            m = _TOML_ML.match(text, at)
            if m:
                kinds.append("MLSTR")
            elif m := _TOML_BASIC.match(text, at) or _TOML_LITERAL.match(text, at):
                kinds.append("STR")
            elif c in "[{":
                kinds.append(c)
                inside.append(c)
                value = c == "["
                at += 1
                continue
            elif c == "]" and inside and inside[-1] == "[":
                m = None
            elif m := _TOML_SCALAR.match(text, at):
                kinds.append("SCALAR")
            if m:
                at = m.end()
                value = False
                continue
        if line_start and c == "[":
            double = text.startswith("[[", at)
            kinds.append("[[" if double else "[")
            inside.append("hh" if double else "h")
            at += 1 + double
            line_start = False
            continue
        line_start = False
        if c == "]":
            top = inside.pop() if inside else ""
            if top == "hh" and text.startswith("]]", at):
                kinds.append("]]")
                at += 2
            else:
                kinds.append("]")
                at += 1
            value = False
            continue
        if c == "}":
            if inside:
                inside.pop()
            kinds.append("}")
            at += 1
            continue
        if c in ".=,":
            kinds.append(c)
            at += 1
            value = c == "=" or (c == "," and bool(inside) and inside[-1] == "[")
            continue
        m = _TOML_KEY.match(text, at) if not value else None
        if m:
            kinds.append("KEY")
            at = m.end()
            continue
        m = (_TOML_BASIC.match(text, at) or _TOML_LITERAL.match(text, at)) if not value else None
        if m:
            kinds.append("STR")
            at = m.end()
            continue
        kinds.append("ERROR")
        break
    return Tokens(kinds, places)


# ---- YAML ----

_YAML_BLANK = re.compile(r"[ ]*")
_YAML_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f￾￿]")
_YAML_DQ = re.compile(r"\"(?:[^\"\\]|\\(?:[0abt\tnvfre \"/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r?\n))*\"")
_YAML_SQ = re.compile(r"'(?:[^']|'')*'")
_YAML_HEADER = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:[ \t]#[^\n]*)?\r?(?:\n|$)")
_YAML_PLAIN = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#)+(?:[ \t]+(?:[^\s:#]|:(?=\S)|(?<=\S)#)+)*")
_YAML_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?![\s,\[\]{}])|(?<=\S)#)+(?:[ \t]+(?:[^\s:#,\[\]{}]|:(?![\s,\[\]{}])|(?<=\S)#)+)*")
_YAML_NAME = re.compile(r"[&*][^\s,\[\]{}]+")
_YAML_TAG = re.compile(r"!(?:<[^>\s]*>|[^\s,\[\]{}]*)")


def yaml_tokens(text: str) -> Tokens:
    """The structure of a YAML stream: indentation as MAPSTART, SEQSTART and END, keys found by their colon."""
    kinds: list[str] = []
    places: list[int] = []
    bad = _YAML_BAD.search(text)
    text = text[: bad.start()] if bad else text
    at, n, line_start = 0, len(text), 0
    if text.startswith("﻿"):
        at = line_start = 1
    indents = [-1]
    flow = 0
    may_key = True
    keys: dict[int, tuple[int, int, int, bool]] = {}  # flow level: token index, line start, column, required

    def emit(kind: str, place: int) -> None:
        kinds.append(kind)
        places.append(place)

    def unwind(column: int, place: int) -> None:
        while indents[-1] > column:
            indents.pop()
            emit("END", place)

    def stale(now: int) -> bool:
        """Forget keys of earlier lines; True if one of them had to be a key."""
        for level in list(keys):
            _, start, _, required = keys[level]
            if start != now:
                del keys[level]
                if required:
                    return True
        return False

    def candidate(column: int, place: int) -> bool:
        if may_key:
            old = keys.get(flow)
            if old and old[3]:
                return False
            keys[flow] = (len(kinds), line_start, column, not flow and indents[-1] == column)
        return True

    while True:
        # to the next token
        while at < n:
            at = _YAML_BLANK.match(text, at).end()
            c = text[at : at + 1]
            if c == "\t" and (flow or at > line_start and not may_key or text[at:].lstrip("\t ")[:1] in ("\n", "\r", "#", "")):
                at += 1
                continue
            if c == "#" and (at == line_start or text[at - 1] in " \t\n"):
                stop = text.find("\n", at)
                at = n if stop < 0 else stop
                continue
            if c == "\r" and text[at + 1 : at + 2] in ("\n", ""):
                at += 1
                continue
            if c == "\n":
                at += 1
                line_start = at
                if not flow:
                    may_key = True
                continue
            break
        if at < n and stale(line_start) or at >= n and stale(-1):
            emit("ERROR", min(at, n))
            break
        column = at - line_start
        if not flow:
            unwind(column if at < n else -1, at)
        if at >= n:
            break
        c = text[at]
        after = text[at + 1 : at + 2]
        spaced = after in ("", " ", "\t", "\n", "\r")
        if column == 0 and not flow and text[at : at + 3] in ("---", "...") and text[at + 3 : at + 4] in ("", " ", "\t", "\n", "\r"):
            unwind(-1, at)
            keys.clear()
            emit("DOCSTART" if c == "-" else "DOCEND", at)
            may_key = False
            at += 3
            continue
        if c == "%" and column == 0 and not flow:
            emit("DIRECTIVE", at)
            stop = text.find("\n", at)
            at = n if stop < 0 else stop
            continue
        if c in "[{":
            if not candidate(column, at):
                emit("ERROR", at)
                break
            emit(c, at)
            flow += 1
            may_key = True
            at += 1
            continue
        if c in "]}":
            keys.pop(flow, None)
            emit(c, at)
            flow = max(0, flow - 1)
            may_key = False
            at += 1
            continue
        if c == "," and flow:
            keys.pop(flow, None)
            emit(",", at)
            may_key = True
            at += 1
            continue
        if c == "-" and spaced:
            if flow or not may_key:
                emit("ERROR", at)
                break
            if column > indents[-1]:
                indents.append(column)
                emit("SEQSTART", at)
            keys.pop(0, None)
            emit("ENTRY", at)
            may_key = True
            at += 1
            continue
        if c == "?" and (spaced or flow and after in ",[]{}"):
            if not flow:
                if not may_key:
                    emit("ERROR", at)
                    break
                if column > indents[-1]:
                    indents.append(column)
                    emit("MAPSTART", at)
            may_key = not flow
            keys.pop(flow, None)
            emit("KEY", at)
            at += 1
            continue
        if c == ":" and (spaced or flow and (after in ",[]{}" or kinds and kinds[-1] in ("SCALAR", "]", "}") and text[at - 1] in "\"']}")):
            key = keys.pop(flow, None)
            if key:
                index, _, key_column, _ = key
                kinds.insert(index, "KEY")
                places.insert(index, places[index] if index < len(places) else at)
                if not flow and key_column > indents[-1]:
                    indents.append(key_column)
                    kinds.insert(index, "MAPSTART")
                    places.insert(index, places[index])
                may_key = False
            else:
                if not flow:
                    if not may_key:
                        emit("ERROR", at)
                        break
                    if column > indents[-1]:
                        indents.append(column)
                        emit("MAPSTART", at)
                may_key = not flow
            emit("VALUE", at)
            at += 1
            continue
        if c in "&*":
            m = _YAML_NAME.match(text, at)
            if not m or not candidate(column, at):
                emit("ERROR", at)
                break
            emit("ANCHOR" if c == "&" else "ALIAS", at)
            may_key = False
            at = m.end()
            continue
        if c == "!":
            if not candidate(column, at):
                emit("ERROR", at)
                break
            emit("TAG", at)
            may_key = False
            at = _YAML_TAG.match(text, at).end()
            continue
        if c in "|>" and not flow:
            m = _YAML_HEADER.match(text, at)
            if not m:
                emit("ERROR", at)
                break
            keys.pop(0, None)
            emit("BLOCKSCALAR", at)
            digit = re.search(r"[1-9]", m[0].split("#")[0])
            at = m.end()
            floor = max(indents[-1], 0) + int(digit[0]) if digit else None
            while at < n:
                stop = text.find("\n", at)
                stop = n if stop < 0 else stop
                line = text[at:stop]
                body = line.strip(" \r")
                depth = len(line) - len(line.lstrip(" "))
                if body:
                    if floor is None:
                        floor = depth if depth > indents[-1] else 1 << 30
                    if depth < floor:
                        break
                at = min(n, stop + 1)
            line_start = at
            may_key = True
            continue
        if c in "\"'":
            m = (_YAML_DQ if c == '"' else _YAML_SQ).match(text, at)
            if not m or not candidate(column, at):
                emit("ERROR", at)
                break
            if re.search(r"\n(?:---|\.\.\.)(?=\s)", m[0]):
                emit("ERROR", at)
                break
            emit("SCALAR", at)
            may_key = False
            last = m[0].rfind("\n")
            if last >= 0:
                line_start = at + last + 1
            at = m.end()
            continue
        if c in ",[]{}#&*!|>'\"%@`" or c in "-?:" and (spaced or flow and c == ":" and after in ",[]{}"):
            emit("ERROR", at)
            break
        # a plain scalar, perhaps over several lines
        pattern = _YAML_PLAIN_FLOW if flow else _YAML_PLAIN
        m = pattern.match(text, at)
        if not m or not candidate(column, at):
            emit("ERROR", at)
            break
        emit("SCALAR", at)
        may_key = False
        at = m.end()
        while True:
            m = re.compile(r"[ \t]*\r?\n(?:[ \t]*\r?\n)*").match(text, at)
            if not m:
                break
            start = m.end()
            first = _YAML_BLANK.match(text, start).end()
            if first >= n or not flow and first - start <= indents[-1] or text[first] == "#" or text[first : first + 1] == "\t":
                break
            if first == start and text[first : first + 3] in ("---", "...") and text[first + 3 : first + 4] in ("", " ", "\n", "\r", "\t"):
                break
            more = pattern.match(text, first)
            if not more or text[first] in ":" and text[first + 1 : first + 2] in ("", " ", "\n"):
                break
            at = more.end()
            line_start = start
            may_key = False
            # a scalar of several lines is no simple key
            if flow in keys:
                if keys[flow][3]:
                    emit("ERROR", at)
                    return Tokens(kinds, places)
                del keys[flow]
    if bad:
        emit("ERROR", bad.start())
    return Tokens(kinds, places)


# ---- Python ----

_PY_STRING_HEAD = re.compile(r"([A-Za-z]{0,2})('''|\"\"\"|'|\")")
_PY = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<comment>#[^\r\n]*)|(?P<nl>\r?\n|\r)|(?P<cont>\\(?:\r?\n|\r))"
    r"|(?P<string>(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''|\"\"\"|'|\"))"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
    r"|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<name>[^\W\d]\w*)|(?P<AUG>\*\*=|//=|<<=|>>=|[-+*/%&|^@]=)|(?P<op>\.\.\.|->|:=|\*\*)|(?P<COMP>==|!=|<=|>=|<(?![<=])|>(?![>=]))"
    r"|(?P<BIN>//|<<|>>|[%&^])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<punct>[-+*/@|~=.,:;])|(?P<ERROR>[\s\S])"
)
_PY_BODY = {
    q: re.compile(rf"(?:[^\\{q}\r\n]|\\(?:\r\n|[\s\S]))*{q}") for q in "'\""
} | {q * 3: re.compile(rf"(?:[^\\{q}]|\\[\s\S]|{q}(?!{q}{q}))*{q * 3}") for q in "'\""}
_PY_WORDS_AFTER_NUMBER = ("and", "else", "for", "if", "in", "is", "or", "not")


def _py_fstring(text: str, at: int, quote: str, raw: bool, kinds: list[str], places: list[int], depth: int, spec: bool = False) -> int:
    """Tokens of an f-string from behind its quote (or of a format specification); the end, or -1 if it is broken."""
    n = len(text)
    while at < n:
        c = text[at]
        if not spec and text.startswith(quote, at):
            return at + len(quote)
        if c == "\\" and not raw:
            if text.startswith("\\N{", at):
                stop = text.find("}", at)
                if stop < 0:
                    return -1
                at = stop + 1
            else:
                at += 2
            continue
        if c in "\r\n" and len(quote) == 1:
            return -1
        if c == "{":
            if not spec and text.startswith("{{", at):
                at += 2
                continue
            at = _py_field(text, at + 1, quote, raw, kinds, places, depth + 1)
            if at < 0:
                return -1
            continue
        if c == "}":
            if spec:
                return at
            if text.startswith("}}", at):
                at += 2
                continue
            return -1
        at += 1
    return -1


def _py_field(text: str, at: int, quote: str, raw: bool, kinds: list[str], places: list[int], depth: int) -> int:
    if depth > 20:
        return -1
    kinds.append("FOPEN")
    places.append(at - 1)
    brackets: list[str] = []
    while True:
        m = _PY.match(text, at)
        if not m:
            return -1
        kind, c = m.lastgroup, m[0]
        if not brackets and c[0] in "}!:=" and kind != "string":
            if c[0] == "=" and c != "==" and (stop := re.compile(r"=\s*(?=[!:}])").match(text, at)):
                at = stop.end()
                continue
            if c[0] == "!" and c != "!=" and (stop := re.compile(r"!\s*[rsa]\s*").match(text, at)):
                kinds.append("CONV")
                places.append(at)
                at = stop.end()
                continue
            if c[0] == ":":
                kinds.append("FSPEC")
                places.append(at)
                mark = len(kinds)
                at = _py_fstring(text, at + 1, quote, raw, kinds, places, depth, spec=True)
                if at < 0:
                    return -1
                # fields inside the specification are checked on their own
                inner = kinds[mark:]
                del kinds[mark:], places[mark:]
                if inner and not _py_fields_ok(inner):
                    return -1
                continue
            if c == "}":
                kinds.append("FCLOSE")
                places.append(at)
                return m.end()
        at = _py_token(text, m, kinds, places, brackets, depth)
        if at < 0:
            return -1


def _py_fields_ok(kinds: list[str]) -> bool:
    from codestrata.llm.derivatives import parse
    from codestrata.llm.grammars import grammar

    return parse(grammar("python"), ["FSTART", *kinds, "FEND", "NEWLINE"]) is None


def _py_token(text: str, m: re.Match, kinds: list[str], places: list[int], brackets: list[str], depth: int) -> int:
    """Adds one token inside brackets or a line; the place behind it, or -1 if it is no token."""
    kind, at = m.lastgroup, m.start()
    if kind in ("ws", "comment", "cont"):
        return m.end()
    if kind == "nl":
        return m.end() if brackets or depth else -1
    if kind == "string":
        head = _PY_STRING_HEAD.match(text, at)
        prefix, quote = head[1].lower(), head[2]
        if "f" in prefix:
            kinds.append("FSTART")
            places.append(at)
            end = _py_fstring(text, head.end(), quote, "r" in prefix, kinds, places, depth)
            if end < 0:
                return -1
            kinds.append("FEND")
            places.append(end)
            return end
        body = _PY_BODY[quote].match(text, head.end())
        if not body:
            return -1
        if "b" in prefix and not body[0].isascii():
            return -1
        kinds.append("BYTES" if "b" in prefix else "STR")
        places.append(at)
        return body.end()
    if kind == "NUM":
        nxt = re.compile(r"\w+").match(text, m.end())
        if nxt and not nxt[0].startswith(_PY_WORDS_AFTER_NUMBER):
            return -1
        if re.fullmatch(r"0[\d_]*[1-9][\d_]*", m[0]):
            return -1
        kinds.append("NUM")
    elif kind == "name":
        kinds.append(m[0] if m[0] in KEYWORDS["python"] else "NAME")
    elif kind == "open":
        brackets.append(m[0])
        kinds.append(m[0])
    elif kind == "close":
        if not brackets or brackets.pop() + m[0] not in ("()", "[]", "{}"):
            return -1
        kinds.append(m[0])
    elif kind == "ERROR":
        return -1
    else:
        kinds.append(m[0] if kind in ("op", "punct") else kind)
    places.append(at)
    return m.end()


_PY_INDENT = re.compile(r"[ \t\f]*")


def python_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    nul = text.find("\0")
    n = len(text)
    at = 1 if text.startswith("﻿") else 0
    indents = [(0, 0)]
    brackets: list[str] = []
    begins = True
    match = _PY.match
    while at < n:
        if begins:
            m = _PY_INDENT.match(text, at)
            rest = text[m.end() : m.end() + 2]
            if rest[:1] in ("", "\n", "\r", "#") or rest[:1] == "\\" and text[m.end() + 1 : m.end() + 2] in "\r\n":
                if rest[:1] == "#":
                    stop = re.compile(r"[^\r\n]*").match(text, m.end()).end()
                else:
                    stop = m.end()
                if rest[:1] == "\\":
                    begins = False
                    at = stop
                    continue
                nl = re.compile(r"\r?\n|\r").match(text, stop)
                if not nl:
                    at = n
                    break
                at = nl.end()
                continue
            wide = narrow = 0
            for c in m[0]:
                if c == "\t":
                    wide = wide // 8 * 8 + 8
                    narrow += 1
                elif c == "\f":
                    wide = narrow = 0
                else:
                    wide += 1
                    narrow += 1
            top = indents[-1]
            if wide == top[0]:
                if narrow != top[1]:
                    kinds.append("ERROR")
                    places.append(at)
                    break
            elif wide > top[0]:
                if narrow <= top[1]:
                    kinds.append("ERROR")
                    places.append(at)
                    break
                indents.append((wide, narrow))
                kinds.append("INDENT")
                places.append(m.end())
            else:
                while indents[-1][0] > wide:
                    indents.pop()
                    kinds.append("DEDENT")
                    places.append(m.end())
                if indents[-1] != (wide, narrow):
                    kinds.append("ERROR")
                    places.append(m.end())
                    break
            begins = False
            at = m.end()
            continue
        m = match(text, at)
        if m.lastgroup == "nl" and not brackets:
            if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                kinds.append("NEWLINE")
                places.append(at)
            begins = True
            at = m.end()
            continue
        if m.lastgroup == "cont" and m.end() >= n:
            kinds.append("ERROR")
            places.append(at)
            break
        end = _py_token(text, m, kinds, places, brackets, 0)
        if end < 0:
            kinds.append("ERROR")
            places.append(at)
            break
        at = end
    else:
        if brackets:
            return Tokens(kinds, places)  # ends inside brackets: the end derivative is not nullable
        if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
            kinds.append("NEWLINE")
            places.append(n)
        kinds.extend(["DEDENT"] * (len(indents) - 1))
        places.extend([n] * (len(indents) - 1))
        if nul >= 0:
            kinds.append("ERROR")
            places.append(nul)
        return Tokens(kinds, places)
    if kinds and kinds[-1] == "ERROR":
        return Tokens(kinds, places)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        kinds.append("NEWLINE")
        places.append(n)
    kinds.extend(["DEDENT"] * (len(indents) - 1))
    places.extend([n] * (len(indents) - 1))
    return Tokens(kinds, places)


# ---- JavaScript and TypeScript ----

_JS_ID = r"(?:[$_]|[^\W\d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[$‌‍]|\w|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_JS = re.compile(
    r"(?P<nl>[\r\n\u2028\u2029]+)|(?P<ws>[ \t\x0b\x0c\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<line>//[^\r\n\u2028\u2029]*)|(?P<comment>/\*[\s\S]*?\*/)"
    r"|(?P<PRIVATE>#" + _JS_ID + r")|(?P<name>" + _JS_ID + r")"
    r"|(?P<NUM>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:\d+(?:_\d+)*n|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?))"
    r"|(?P<STR>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')|(?P<tick>`)"
    r"|(?P<ASSIGN>\*\*=|<<=|&&=|\|\|=|\?\?=|[-+*/%&|^]=)|(?P<op>\.\.\.|=>|\+\+|--|\?\.(?!\d)|>=)|(?P<BIN>===|!==|==|!=|<=|<<|\*\*|&&|\|\||\?\?|[%^])"
    r"|(?P<punct>[{}()\[\];,<>+\-*/&|!~?:=.@])|(?P<ERROR>[\s\S])"
)
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029]|\[(?:[^\]\\\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029])*\])+/[A-Za-z]*")
_OPERAND = frozenset(["NAME", "NUM", "STR", "REGEX", "TEMPLATE", "TTAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])


_TYPE_CHARS = re.compile(r"[\w$.,\s\[\]|&'\":?{};]*")


def _type_arguments(text: str, at: int) -> bool:
    """Whether the ``<`` directly behind a name opens type arguments of a call: balanced, and followed by ``(``."""
    depth, end = 0, min(len(text), at + 300)
    while at < end:
        c = text[at]
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if not depth:
                return text[at + 1 : at + 2] == "("
        else:
            return False
        at = _TYPE_CHARS.match(text, at + 1).end()
    return False


def ecma_tokens(text: str, language: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    fresh: list[bool] = []
    words = KEYWORDS[language]
    soft = words - KEYWORDS["javascript"] | frozenset("async get set of let static from as".split())
    at, n = 0, len(text)
    new_line = True
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at):
        kinds.append("HASHBANG")
        places.append(at)
        fresh.append(True)
        at = re.compile(r"[^\r\n]*").match(text, at).end()
    braces: list[bool] = []  # whether a brace was opened by a template
    parens: list[bool] = []  # whether a parenthesis belongs to if, for, while or with
    heads = False
    generic = language == "typescript"
    match = _JS.match
    while at < n:
        m = match(text, at)
        kind, c = m.lastgroup, m[0]
        if kind == "ws" or kind == "line":
            at = m.end()
            continue
        if kind == "nl":
            new_line = True
            at = m.end()
            continue
        if kind == "comment":
            new_line = new_line or "\n" in c or "\r" in c
            at = m.end()
            continue
        end = m.end()
        if c[0] == "/" and kind in ("punct", "ASSIGN"):
            kind = c if kind == "punct" else kind
            last = kinds[-1] if kinds else ""
            operand = last in _OPERAND or last in soft
            if last == ")" and heads:
                operand = False
            if last == "}" and new_line:
                operand = False
            if not operand:
                r = _JS_REGEX.match(text, at)
                kind = "REGEX" if r else "ERROR"
                end = r.end() if r else end
        elif kind == "name":
            kind = c if c in words and not (kinds and kinds[-1] in (".", "?.") and c not in words) else "NAME"
        elif kind == "NUM":
            if re.compile(r"[\w$]").match(text, end):
                kind = "ERROR"
        elif kind == "tick":
            t = _JS_TEMPLATE.match(text, end)
            if not t:
                kind = "ERROR"
            elif t["end"] == "`":
                kind, end = "TEMPLATE", t.end()
            else:
                kind, end = "THEAD", t.end()
                braces.append(True)
        elif kind == "op":
            kind = c
        elif kind == "punct":
            kind = c
            if c == "{":
                braces.append(False)
            elif c == "}":
                if braces and braces.pop():
                    t = _JS_TEMPLATE.match(text, end)
                    if not t:
                        kind = "ERROR"
                    elif t["end"] == "`":
                        kind, end = "TTAIL", t.end()
                    else:
                        kind, end = "TMIDDLE", t.end()
                        braces.append(True)
            elif c == "(":
                parens.append(bool(kinds) and kinds[-1] in ("if", "for", "while", "with"))
            elif c == ")":
                heads = bool(parens) and parens.pop()
            elif c == "<" and generic and kinds and kinds[-1] == "NAME" and text[at - 1] not in " \t\n" and _type_arguments(text, at):
                kind = "LTYPE"
        kinds.append(kind)
        places.append(at)
        fresh.append(new_line)
        new_line = False
        if kind == "ERROR":
            break
        at = end
    return Tokens(kinds, places, fresh)


# ---- Java ----

_JAVA = re.compile(
    r"(?P<skip>[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<name>(?:[$_]|[^\W\d])(?:\$|\w)*)"
    r"|(?P<num>(?:0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?\.?[0-9a-fA-F_]*[pP][+-]?\d[\d_]*[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?"
    r"|(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d[\d_]*)?[fFdDlL]?))"
    r"|(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"{1,2}(?!\"))*\"\"\")|(?P<str>\"(?:[^\"\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\")"
    r"|(?P<chr>'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    r"|(?P<ASSIGN><<=|[-+*/%&|^]=)|(?P<op>\.\.\.|->|::|\+\+|--|>=)|(?P<BIN><<|&&|\|\||==|!=|<=|[*/%^])|(?P<punct>[{}()\[\];,<>+\-&|!~?:=.@])|(?P<ERROR>[\s\S])"
)
_JAVA_PRIM = frozenset("byte short int long char float double boolean".split())


def java_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words = KEYWORDS["java"]
    for m in _JAVA.finditer(text, 1 if text.startswith("﻿") else 0):
        kind = m.lastgroup
        if kind == "skip":
            continue
        c = m[0]
        if kind == "name":
            kind = c if c in words else "PRIM" if c in _JAVA_PRIM else "LIT" if c in ("true", "false", "null") else "ERROR" if c == "_" else "NAME"
        elif kind == "num":
            kind = "ERROR" if text[m.end() : m.end() + 1].isalnum() else "LIT"
        elif kind in ("text", "str", "chr"):
            kind = "LIT"
        elif kind in ("op", "punct"):
            # in `* import`, the star of a declaration is a token of its own
            kind = c
        elif c == "*" and kinds and kinds[-1] == ".":
            kind = "*"
        kinds.append(kind)
        places.append(m.start())
        if kind == "ERROR":
            break
    return Tokens(kinds, places)


# ---- Go ----

_GO = re.compile(
    r"(?P<nl>\n)|(?P<ws>[ \t\r]+)|(?P<line>//[^\n]*)|(?P<comment>/\*[\s\S]*?\*/)|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d[\d_]*)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?)"
    r"|(?P<STR>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`)"
    r"|(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<ASSIGN>&\^=|<<=|>>=|[-+*/%&|^]=)|(?P<op>\.\.\.|:=|<-|\+\+|--)|(?P<BIN>&\^|<<|>>|&&|\|\||==|!=|<=|>=|[<>/%])|(?P<punct>[{}()\[\];,+\-*&|^!~:=.])|(?P<ERROR>[\s\S])"
)
_GO_END = frozenset(["NAME", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def go_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words = KEYWORDS["go"]
    nul = "\0" in text
    for m in _GO.finditer(text, 1 if text.startswith("﻿") else 0):
        kind = m.lastgroup
        if kind in ("ws", "line"):
            continue
        c = m[0]
        if kind == "nl" or kind == "comment" and "\n" in c:
            if kinds and kinds[-1] in _GO_END:
                kinds.append(";")
                places.append(m.start())
            continue
        if kind == "comment":
            continue
        if kind == "name":
            kind = c if c in words else "NAME"
        elif kind == "num":
            kind = "ERROR" if text[m.end() : m.end() + 1].isalnum() or re.fullmatch(r"0[\d_]*[89][\d_]*", c) else "LIT"
        elif kind == "rune":
            kind = "LIT"
        elif kind in ("op", "punct"):
            kind = c
        kinds.append(kind)
        places.append(m.start())
        if kind == "ERROR":
            return Tokens(kinds, places)
    if kinds and kinds[-1] in _GO_END:
        kinds.append(";")
        places.append(len(text))
    if nul:
        kinds.append("ERROR")
        places.append(text.index("\0"))
    return Tokens(kinds, places)


def tokens(language: str, text: str) -> Tokens:
    """The tokens of a text in a language of the ``languages`` table."""
    if language in ("javascript", "typescript"):
        return ecma_tokens(text, language)
    return {"json": json_tokens, "toml": toml_tokens, "yaml": yaml_tokens, "python": python_tokens, "java": java_tokens, "go": go_tokens}[language](text)
