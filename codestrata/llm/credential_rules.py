"""How a credential looks in source text: names, places and values. Plain Python, no Spark.

``candidates`` finds every literal of one text that stands where a credential could stand. Each has its
evidence: *structured* (the value alone has the format of an issued secret), *url* and *header* (a login in
a URL or header), *named* (a literal given to a credential's name). What is a placeholder, a reference, a
checksum, an id or a mere name is refused here; what only the corpus can tell is left to ``secrets``.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import NamedTuple

# ---- Fixed values: words that name a credential, in several languages --------------------------------
NAME_WORDS = [
    "password", "passwd", "passphrase", "passcode", "passwort", "kennwort", "mot_de_passe", "motdepasse", "contrasena",
    "contraseña", "clave", "senha", "haslo", "hasło", "heslo", "losenord", "lösenord", "wachtwoord", "parola", "пароль",
    "pwd", "pass", "pw", "secret", "token", "apikey", "api_key", "accesskey", "access_key", "private_key", "privatekey",
    "signing_key", "signingkey", "encryption_key", "encryptionkey", "secret_key", "secretkey", "auth_key", "authkey",
    "master_key", "account_key", "shared_key", "credential", "credentials", "authorization", "auth_header", "auth",
]
#: Words after a name that make it a mere name, a setting or something public about the credential.
NOT_VALUES_OF = [
    "name", "header", "field", "length", "len", "min", "max", "type", "url", "uri", "path", "file", "dir", "hash", "id", "hint",
    "label", "placeholder", "policy", "reset", "expiry", "expires", "ttl", "count", "limit", "prompt", "help", "param", "regex",
    "pattern", "env", "var", "ref", "arn", "public", "digest", "checksum", "integrity", "fingerprint", "error", "message",
    "strength", "valid", "enabled", "required", "scope", "endpoint", "store",
]
# ------------------------------------------------------------------------------------------------------

_WORDS = {w.replace("_", "") for w in NAME_WORDS}
#: Formats of issued secrets (public formats of common services).
STRUCTURED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}"
    r"|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abeoprs]-[A-Za-z0-9]{6,}(?:-[A-Za-z0-9]{6,})+"
    r"|(?:sk|rk)_live_[A-Za-z0-9]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{30,}"
    r"|hv[sb]\.[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{50,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r")"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Runs of a private key's body, without the escapes and quotes around its lines.
KEY_BODY = re.compile(r"(?<!\\)(?:(?<=\\n)|(?<=\\r))?(?:[A-Za-z0-9+/]{4,}={0,2}|[A-Za-z0-9+/]{2,3}=)")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,30}://(?P<user>[^\s:/@'\"`<>{}$]*):(?P<pw>[^\s/@'\"`<>]{3,})@(?=[A-Za-z0-9\[])")
SCHEME = re.compile(r"(?i)\b(?P<scheme>basic|bearer|token)[ \t]+(?P<value>[A-Za-z0-9+/=_.~-]{8,})")
#: Where a credential's name may begin; the whole identifier around it is then read.
ANCHOR = re.compile(
    r"(?i)pass|pwd|pw(?![a-z])|secret|token|api_?-?key|access_?-?key|private_?-?key|signing_?-?key|encryption_?-?key|auth_?-?key|account_?-?key"
    r"|shared_?-?key|master_?-?key|credential|authorization|kennwort|contrase|senha|has[lł]o|heslo|l[oö]senord|wachtwoord|parola|пароль|clave"
)
_QUOTED = r"""(?P<prefix>[bBrRuUfF@]{0,2})(?P<q>'{3}|"{3}|["'`])(?P<value>(?:[^\r\n\\"'`]++|\\.|(?!(?P=q))["'`])++)(?P=q)"""
#: Between a name and its quoted literal: closing marks, a type, an operator, wrappers such as []byte( or an opening bracket.
GIVEN = re.compile(
    r"""["'`\])]{0,2}\s{0,4}(?:(?::|\s)\s{0,2}[\w.<>\[\]|]{1,40}\s{0,2}(?==))?(?::=|[=!]==?|=>|->|=|:|,|\|\||\?\?|\?:|\bor\b)\s{0,8}"""
    r"""(?:\[\]byte\(|[\w.]{0,20}\(\s{0,80})?"""
    + _QUOTED
)
#: NAME = <anything without quotes>, "literal"  (several names on the left)
TUPLE = re.compile(r"""\s{0,4}=\s{0,4}[\w.()-]{1,40},\s{0,4}""" + _QUOTED)
#: NAME=value up to the end of the line, as in env files, properties, YAML and comments.
BARE = re.compile(r"""[ \t]{0,8}(?:[:=]|->|=>)[ \t]{0,8}(?P<value>[^\s"'`,;<>(){}][^\s"'`]{3,}?)[,;]?[ \t]*(?=\r?\n|\r?$|`)""")
#: A name in prose, a few words, then the value: `NAME for the old box -> value`.
PROSE_ARROW = re.compile(r"""(?:[ \t]+[\w'-]+){1,6}?[ \t]*(?:->|=>|:|=)[ \t]*(?P<value>[^\s"'`,;<>(){}][^\s"'`]{5,}?)[ \t]*(?=\r?\n|\r?$)""")
PROSE_QUOTED = re.compile(r"""[ \t]+(?:is[ \t]+)?(?P<q>[`"'])(?P<value>[^`"'\s]{4,})(?P=q)""")
FLAG = re.compile(r"""(?:=|[ \t]+)(?P<q>["']?)(?P<value>[^\s"',\]]{4,})(?P=q)""")
USER_FLAG = re.compile(r"""(?:-u|--user)(?:=|[ \t]+)["']?[\w.@-]{1,64}:(?P<q>["']?)(?P<value>[^\r\n"'\s]{3,})(?P=q)(?=["'\s]|$)""")
#: `name: client_secret`, and on the next line `value: "..."`.
VALUE_LINE = re.compile(r"""["'],?\s{1,200}["']?value["']?\s{0,4}[:=]\s{0,4}(?P<q>["']?)(?P<value>[^"'\r\n]{4,}?)(?P=q)\s{0,4},?(?=\s|$)|[ \t]*\r?\n[ \t]*value[ \t]*[:=][ \t]*(?P<q2>["']?)(?P<value2>[^"'\r\n]{4,}?)(?P=q2)[ \t]*(?=\r?\n|\r?$)""")
#: The next piece of a literal that is put together from several.
JOINED = re.compile(r"""[ \t]*(?:\+|\.|&|\\)?[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+[ \t]*)?(?P<q>["'`])(?P<value>(?:[^\r\n\\"'`]++|\\.|(?!(?P=q))["'`])++)(?P=q)""")
_IDENT = re.compile(r"[\w.\-]")

_SPLIT = re.compile(r"[A-ZÀ-Ý]+(?![a-zà-ÿ])|[A-ZÀ-Ý]?[a-zà-ÿĀ-ž]+|[А-Яа-я]+|\d+")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_PLACE = re.compile(
    r"""(?ix) ^[<\[({$%*.x#?-]+$ | ^<.*>$ | \$\{ | \{\{ | \}\} | \$\( | ^\$[A-Za-z_\d] | ^%[sd]$ | %\(\w+\)[sd] | ^\{[\w.]*\}$ | ^%\w+%$
    | ^@\w+@$ | \#\{ | (?:^|[\W_])(?:your|my|the|some|insert|enter|paste|replace|change|redacted|removed|hidden|masked|dummy|sample|
    example|placeholder|default|todo|tbd|fixme|none|null|nil|undefined|empty|secret\s*here|here)(?:$|[\W_]) | changeme | changeit
    | ^(.)\1{4,}$ | ^[*•·x.]{4,}$ | ^vault:|^vault/|^secret/|^kms:|^arn:|^ref: | ^env[.:(]|^os\.|^process\.env|^System\. """
)


class Candidate(NamedTuple):
    start: int
    end: int
    value: str
    evidence: str
    pieces: tuple[tuple[int, int], ...] = ()
    """Where the text of the value stands, if it is put together from several literals."""


def name_says(name: str) -> bool:
    """Whether a name is that of a credential's value: its last words say so."""
    words = [w.lower() for w in _SPLIT.findall(name.replace("-", "_"))]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in NOT_VALUES_OF:
        return False
    for n in (1, 2, 3):
        if "".join(words[-n:]) in _WORDS:
            return not (n == 1 and words[-1] in ("pass", "auth", "token", "pw", "clave") and len(words) == 1 and len(name) < 2)
    # dbPassword, PGPASSWORD, x_api_key
    last = words[-1]
    return any(last.endswith(w) for w in ("password", "passwd", "apikey", "kennwort", "passwort", "secret", "token", "passphrase")) or last in (
        "authtoken",
        "secretkey",
    )


def placeholder(value: str) -> bool:
    return bool(_PLACE.search(value))


def classes(value: str) -> int:
    return sum(
        (any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value))
    )


def _mixed(letters: str) -> bool:
    """Letters whose case changes as no camelCase name does."""
    pieces = _SPLIT.findall(letters)
    return len(pieces) >= 3 and len(letters) < 3.5 * len(pieces)


def plausible(value: str) -> bool:
    """A literal given to a credential's name that can be its value: no reference, placeholder, word or sentence."""
    if len(value) < 6 or any(c.isspace() for c in value) or placeholder(value):
        return False
    if not any(c.isalnum() for c in value) or len(set(value)) < 4:
        return False
    if re.match(r"^(?:https?|file|s3|gs)://[^@]*$", value) or value.startswith(("./", "../", "~/")):
        return False
    if re.match(r"^[A-Za-z_][\w.]*[\[(]", value) or re.match(r"^[\w-]*(?:/[\w.-]+)+$", value) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", value):
        return False
    if re.match(r"^\d{1,9}$", value):
        return False
    if re.match(r"^[A-Za-z]+(?:[_.][A-Za-z]+)*$", value):  # a mere name, unless its letters are mixed at random
        return any(_mixed(part) for part in re.split(r"[_.]", value))
    words = value.split("-")
    if all(w.isalpha() for w in words):  # a passphrase of words; two words are a mere name
        return len(words) >= 3 and all(w.islower() for w in words)
    return True


def _decodes_to_login(value: str) -> bool:
    try:
        text = base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return ":" in text[1:] and text.isprintable()


def header_value(scheme: str, value: str) -> bool:
    if placeholder(value):
        return False
    if scheme.lower() == "basic":
        return _decodes_to_login(value)
    return bool(STRUCTURED.fullmatch(value) or _UUID.match(value) or len(value) >= 16 and any(c.isdigit() for c in value) and plausible(value))


def _identifier(text: str, start: int, end: int) -> tuple[int, int]:
    while start > 0 and _IDENT.match(text[start - 1]):
        start -= 1
    while end < len(text) and _IDENT.match(text[end]):
        end += 1
    # `--password=x`, `a->token`, `token.` at the end of a sentence: marks are not part of the name
    while end > start and text[end - 1] in ".-":
        end -= 1
    return start, end


def _joined(text: str, end: int, value: str, pieces: list[tuple[int, int]]) -> tuple[int, str]:
    """A literal with the pieces that follow it: `"ab" + "cd"`."""
    while True:
        m = JOINED.match(text, end)
        between = text[end : m.start("q")] if m else ""
        if not m or not ("+" in between or between and between.strip() in ("", "\\")):
            break
        end, value = m.end(), value + m["value"]
        pieces.append((m.start("value"), m.end("value")))
    return end, value


#: What may stand between the lines of a private key: line ends and their escapes, quotes, joins.
_KEY_GAP = re.compile(r"""(?:\\[nrt]|[\s"'`+,.;&()#*\\])*""")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
#: Least characters of a private key's body, and of a full line in one that has no END line.
_KEY_LEAST, _KEY_FULL = 24, 24


def _key_end(text: str, at: int, limit: int) -> int | None:
    """Where the block of a private key ends whose frame begins before ``at``; None if no body follows.

    The body is its lines up to the END line before the next key. Without one it ends with the last full line,
    or the one shorter line after it that stands alone; words of prose or code are neither.
    """
    stop = PEM_END.search(text, at, limit)
    body, end, full = 0, at, False
    while True:
        begin = _KEY_GAP.match(text, end, limit).end()
        m = _KEY_LINE.match(text, begin, limit)
        if m is None:
            break
        size = m.end() - begin
        if size < _KEY_FULL and not stop:
            alone = m.end() == len(text) or text[m.end()] in "\r\n\"'`\\"
            if full and alone and (size % 4 == 0 or m[0].endswith("=")) and not (m[0].isalpha() and m[0].islower()):
                body, end = body + size, m.end()
            break
        if stop and m.end() > stop.start():
            break
        body, end, full = body + size, m.end(), True
    if body < _KEY_LEAST:
        return None
    return stop.end() if stop else end


def candidates(text: str) -> Iterator[Candidate]:
    """Every place of one text where the text of a usable credential stands, in no particular order.

    Places of one credential may come twice with different evidence.
    """
    heads = list(PEM.finditer(text))
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        end = _key_end(text, m.end(), after)
        if end is not None:
            yield Candidate(m.start(), end, text[m.start() : end], "structured")
    for m in STRUCTURED.finditer(text):
        yield Candidate(m.start(), m.end(), m[0], "structured")
    if "://" in text:
        for m in URL.finditer(text):
            pw = m["pw"]
            if not placeholder(pw) and not placeholder(m["user"]) and len(pw) >= 4 and not re.fullmatch(r"(?i)\W*(?:pass(?:word|wd)?|pwd|pw|secret|token)\W*", pw):
                yield Candidate(m.start("pw"), m.end("pw"), pw, "url")
    for m in SCHEME.finditer(text):
        if header_value(m["scheme"], m["value"]):
            yield Candidate(m.start("value"), m.end("value"), m["value"], "header")
    if ":" in text:
        for m in USER_FLAG.finditer(text):
            if plausible(m["value"]):
                yield Candidate(m.start("value"), m.end("value"), m["value"], "named")
    done = 0
    for anchor in ANCHOR.finditer(text):
        if anchor.start() < done:
            continue
        start, end = _identifier(text, anchor.start(), anchor.end())
        name = text[start:end]
        done = end
        if not name_says(name):
            continue
        m = GIVEN.match(text, end)
        if m is None and text[max(0, start - 80) : start].rstrip().endswith(","):
            m = TUPLE.match(text, end)
        if m is not None:
            pieces = [(m.start("value"), m.end("value"))]
            _, value = _joined(text, m.end(), m["value"], pieces)
            if plausible(value) and not ("f" in m["prefix"].lower() and "{" in value):
                yield Candidate(pieces[0][0], pieces[-1][1], value, "named", tuple(pieces) if len(pieces) > 1 else ())
            continue
        m = BARE.match(text, end) or PROSE_QUOTED.match(text, end)
        if m is None and text[max(0, start - 2) : start] == "--" or start and text[start] == "-":
            m = FLAG.match(text, end)
        if m is None:
            m = VALUE_LINE.match(text, end)
            if m is not None:
                g = "value" if m["value"] is not None else "value2"
                if plausible(m[g]):
                    yield Candidate(m.start(g), m.end(g), m[g], "named")
                continue
        if m is None:
            line_start = text.rfind("\n", 0, start) + 1
            before = text[line_start:start]
            if re.match(r"^\s*(?:#|//|/\*|\*|--|;|<!--)", before):
                m = PROSE_ARROW.match(text, end)
            elif re.search(r"(?:#|//|--)\s*$", before) and re.match(r"[ \t]*\r?(?:\n|$)", text[end:]):
                # if given == 'literal':  # its name
                lits = [x for x in re.finditer(r"""(?P<q>["'])(?P<value>(?:\\.|(?!(?P=q)).){4,})(?P=q)""", before) if plausible(x["value"])]
                if lits:
                    x = lits[-1]
                    yield Candidate(line_start + x.start("value"), line_start + x.end("value"), x["value"], "named")
                continue
        if m is not None and plausible(m["value"]):
            yield Candidate(m.start("value"), m.end("value"), m["value"], "named")
