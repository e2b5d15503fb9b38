"""What a single file says about itself: generated, minified or packed, or data stored as code. Plain Python.

Marks count only where tools put them: in the comments before the first line of code or in the last comment,
and only as the statement of the comment; text that merely mentions them, strings and templates do not count.
The other rules look at the composition of the file: literals against names, white space, line lengths,
lengths of names, and lines that repeat with running numbers.
"""

from __future__ import annotations

import re
from collections import Counter

# ---- Fixed values ------------------------------------------------------------------------------------
#: Files that package managers write.
LOCK_FILES = {
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "poetry.lock", "pipfile.lock", "pdm.lock",
    "uv.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum", "podfile.lock", "mix.lock", "flake.lock", "packages.lock.json",
    "gradle.lockfile", "pubspec.lock",
}
#: Endings of texts that are no program source: they are never data stored as code.
NOT_CODE = {
    "md", "rst", "txt", "env", "ini", "cfg", "conf", "properties", "toml", "yaml", "yml", "csv", "tsv", "xml", "html", "htm", "svg", "log",
    "json", "lock", "adoc", "tex", "po", "pem",
}
#: Traces that compilers, bundlers and parser generators leave.
ARTEFACTS = [
    r'Object\.defineProperty\(exports, ?["\']__esModule["\']', r"^//[#@] sourceMappingURL=", r"__webpack_require__", r"^_lr_action_items\s*=",
    r"\.AddSerializedFile\(", r"^_[A-Z][A-Za-z0-9_]*\._serialized_start\s*=", r"^DESCRIPTOR\s*=\s*_?\w+\.\w+\(b?['\"]", r"^_tabversion\s*=",
    r"^//\s*line \S+\.[ly]:\d+$", r"^#line \d+ \"", r"^\s*parcelRequire\s*=",
]
#: Statements of generated files, at the beginning of a comment.
_MADE = (
    r"generated|auto-?generated|written|created|produced|built|emitted|erzeugt|generiert|erstellt|g[ée]n[ée]r[ée]e?|generad[oa]|gerad[oa]"
    r"|wygenerowan\w*|utworzon\w*|vygenerov\w*|vytvo[rř]en\w*|genererad\w*|skapad\w*|сгенерирован\w*|создан\w*|生成"
)
_AUTO = (
    r"auto(?:mati(?:cally|sch|quement|camente)|máticamente|maticky|matycznie|matiskt)?|machine|автоматически|自動"
)
MARKS = [
    r"@(?:auto)?generated\b",
    r"(?:code|source|file) (?:auto-?)?generated\b",
    rf"(?:{_AUTO})[- ]?(?:{_MADE})\b",
    r"(?:auto-?)?generated (?:by|from|with|on|at|using|automatically|code|file|via|during)\b",
    rf"(?:[\w@]+:\s*|[A-Za-z]+!\s*)?(?:this|the|these|diese[rs]?|dies|das|ce(?:tte|t)?|le|este|esta|o|ten|ta|to|tento|denna|den h[aä]r|этот|файл|この)\s+(?:[\w.\-]+\s+){{0,4}}?"
    rf"(?:is|are|was|were|has been|have been|wurde|wird|ist|a été|est|fue|ha sido|foi|é|został\w*|jest|byl\w*|är|har|был\w*)\s+(?:[\w-]+\s+)?(?:{_AUTO})?[- ]?(?:{_MADE})\b"
    rf"(?=.*(?:{_AUTO}|\bby\b|\bfrom\b|\bvon\b|\baus\b|\bpar\b|\bpor\b|\bprzez\b|\bav\b|edit|modif|[äa]nder|bearbeit))",
    rf".{{0,60}}?(?:{_AUTO})[- ]?(?:{_MADE})\b.{{0,60}}?(?:do not|don't|nicht|ne pas|no (?:editar|modificar)|não|nie |neupravuj|inte|не )",
    r"lock ?file (?:written|generated|created|managed)\b",
    r"(?:automatically|auto-) ?written by\b",
    r"\$?[A-Z][A-Z]{2,8}(?:LR)? \S+\.[a-z]\w{0,4} \d+(?:\.\d+)+(?: |$)",
]
# ------------------------------------------------------------------------------------------------------

_ARTEFACT = re.compile("|".join(f"(?:{a})" for a in ARTEFACTS), re.M)
#: One of these stands in every such trace.
_IN_ARTEFACTS = ["__esModule", "sourceMappingURL", "__webpack_require__", "_lr_action_items", "AddSerializedFile", "_serialized_start", "DESCRIPTOR", "_tabversion", "line ", "parcelRequire"]
_MARK = re.compile("|".join(f"(?:{m})" for m in MARKS), re.I)
_COMMENT = re.compile(r"^\s*(?:#(?!\[)|//|/\*|\*|--|;|<!--|%|\"{3}|'{3}|\{-|\(\*)")
_LEAD = re.compile(r"^[\s#/*;%!<>\-\"'{(]+")
_PREAMBLE = re.compile(r"^\s*(?:#!.*|---|package [\w.]+;?|[\"']use strict[\"'];?|<\?(?:php|xml).*)\s*$")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_DIGITS = re.compile(r"\d+")
_FIVE = re.compile(r"(?:[^\W_][\W_]*){5}")


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def is_code(path: str) -> bool:
    return extension(path) not in NOT_CODE


def _block_comment_ends(line: str) -> bool:
    return "*/" in line or "-->" in line


def marked(lines: list[str]) -> bool:
    """Whether the comments before the code, or the last comment, state that the file was generated."""
    inside = False
    for line in lines:
        if not line.strip() or _PREAMBLE.match(line):
            continue
        if not inside and not _COMMENT.match(line):
            break
        quoted = re.match(r"^\s*(\"{3}|'{3})", line)
        text = _LEAD.sub("", line)
        if _MARK.match(text):
            return True
        if inside:
            inside = not (_block_comment_ends(line) or '"""' in line or "'''" in line)
        elif re.match(r"^\s*(?:/\*|<!--)", line):
            inside = not _block_comment_ends(line)
        elif quoted:
            inside = line.count(quoted[1]) == 1
    for line in reversed(lines):
        if not line.strip():
            continue
        if not re.match(r"^\s*(?:#|//|--|;)", line):
            break
        if _MARK.match(_LEAD.sub("", line)):
            return True
    return False


def reason(path: str, text: str) -> str | None:
    """Why a file is not hand-written, as far as the file itself shows: lock, generated, minified, data; or None."""
    name = path.rsplit("/", 1)[-1].lower()
    if name in LOCK_FILES:
        return "lock"
    lines = text.replace("\r\n", "\n").split("\n")
    if marked(lines):
        return "generated"
    ext = extension(path)
    if ext in ("md", "rst", "txt", "adoc", "tex"):
        return None
    body = [ln for ln in lines if ln.strip() and not _COMMENT.match(ln)]
    size = sum(map(len, body))
    if not body:
        return None
    code = ext not in NOT_CODE
    if code and any(x in text for x in _IN_ARTEFACTS) and _ARTEFACT.search(text):
        return "generated"
    joined = "\n".join(body)
    blanks = sum(map(joined.count, (" ", "\t", "\n")))
    dense = size - blanks
    if ext == "json":
        long_share = sum(len(ln) for ln in body if len(ln) > 180) / size
        return "minified" if size > 400 and long_share > 0.9 and blanks < 0.12 * size else None
    if not code:
        return None
    strings = _STRING.findall(joined)
    bare = _STRING.sub('""', joined)
    numbers = _NUMBER.findall(bare)
    literal = sum(map(len, strings)) + sum(map(len, numbers))
    full = literal >= 400 and literal >= 0.62 * dense
    # Long lines count without their literals: one long text in a line of its own is no packed code.
    plain = bare.split("\n")
    length = sum(map(len, plain))
    long_share = sum(len(ln) for ln in plain if len(ln) > 120) / max(length, 1)
    names = _NAME.findall(_NUMBER.sub("0", bare)) if full or long_share > 0.6 else []
    if full and len(names) <= 0.5 * (len(strings) + len(numbers)) + 15 and _flat(body):
        return "data"
    if long_share > 0.6 and names:
        short = sum(len(n) <= 2 for n in names) / len(names)
        if sum(map(bare.count, (" ", "\t", "\n"))) < 0.13 * length or short > 0.35:
            return "minified"
    # Lines that are the same but for running numbers.
    if len(body) < 15:
        return None
    masks = Counter(map(str.strip, _DIGITS.sub("0", joined).split("\n")))
    mask, n = masks.most_common(1)[0]
    if n >= 15 and n >= 0.6 * len(body) and "0" in mask:
        runs = [[int(d) for d in _DIGITS.findall(ln)] for ln in body if _DIGITS.sub("0", ln.strip()) == mask]
        if all(a and b and b[-1] == a[-1] + 1 for a, b in zip(runs, runs[1:], strict=False)):
            return "generated"
    return None


def _flat(body: list[str]) -> bool:
    """Hardly any statement but the literals: lines with control flow or calls are few."""
    busy = sum(bool(re.search(r"\b(?:def|if|for|while|return|func|function|else|try|switch|case|assert|lambda)\b|=>", _STRING.sub('""', ln))) for ln in body)
    return busy <= max(1, 0.05 * len(body))


def significant_lines(text: str) -> list[str]:
    """Lines of code that can tell files apart: no comments, no lone brackets, white space evened out."""
    out = []
    for line in text.split("\n"):
        line = " ".join(line.split())
        if len(line) >= 8 and _FIVE.search(line) and not _COMMENT.match(line):
            out.append(line)
    return out
