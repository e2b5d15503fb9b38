"""Problem 9: text that was decoded with the wrong encoding. Plain Python: chains, n-gram model, decisions.

A *chain* says that bytes of encoding ``right`` were read as ``wrong``; undoing it is encoding with ``wrong``
and decoding with ``right``. Every candidate chain of every token with a non-ASCII character is scored by a
character trigram model with Witten-Bell smoothing, and the gain in log-likelihood over the text as it stands
is its evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

# ---- Fixed values: encodings that are confused in practice -------------------------------------------
WRONG_FOR_UTF8 = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-2", "cp866", "cp1254"]
SINGLE_BYTE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-5"]
MULTI_BYTE = ["cp932", "euc_jp", "gbk", "big5", "euc_kr"]
# ------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^ \t\r\n]+")
#: Longer tokens (lines of scripts without spaces) hardly come twice; what is known about them is not kept.
KEPT_TOKEN = 64
_UTF8 = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
#: Inline code or a quotation that holds nothing but a few characters: a cited sequence.
CITED = re.compile(r"(`|``|\"|'|“|„|«|‘)(?P<x>[^\sA-Za-z0-9`\"“”„«»'’]{1,8})(`|``|\"|'|”|“|»|’)")
_BESIDE = re.compile(r"[A-Za-z][\u0370-\u1fff\u3040-\ud7ff]|[\u0370-\u1fff\u3040-\ud7ff][A-Za-z]")
_INSIDE = re.compile(r"[A-Za-z][\u0370-\u1fff\u3040-\ud7ff]+[A-Za-z]")
_WITHIN = frozenset("'’‘ʼ-‐‑–·")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")


class Chain(NamedTuple):
    wrong: str
    right: str
    twice: bool = False


@lru_cache(maxsize=None)
def _encoder(name: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves out stand for the C1 control, as in common software."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _single(wrong: str, right: str) -> dict[str, str]:
    """Character read to character meant, for two one-byte encodings."""
    out = {}
    for ch, b in _encoder(wrong).items():
        try:
            meant = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if meant != ch:
            out[ch] = meant
    return out


def chains() -> list[Chain]:
    utf8 = [Chain(w, "utf-8") for w in (*WRONG_FOR_UTF8, *MULTI_BYTE)]
    twice = [Chain(w, "utf-8", True) for w in ("cp1252", "latin-1")]
    single = [Chain(w, r) for w in SINGLE_BYTE for r in SINGLE_BYTE if w != r]
    multi = [Chain(w, r) for w in ("cp1252", "latin-1") for r in MULTI_BYTE]
    return [*utf8, *twice, *single, *multi]


def _undo_utf8(token: str, wrong: str) -> str | None:
    """The token with every UTF-8 sequence that its characters spell in ``wrong`` put right; None if there is none."""
    if wrong in MULTI_BYTE:
        return _undo_multi(token, wrong)
    enc = _encoder(wrong)
    raw = bytes(b if (b := enc.get(c)) is not None else (ord(c) if ord(c) < 128 else 255) for c in token)
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        out.append(token[at : m.start()])
        out.append(m[0].decode("utf-8"))
        at = m.end()
    if not out:
        return None
    out.append(token[at:])
    return "".join(out)


def _undo_multi(token: str, wrong: str) -> str | None:
    """UTF-8 read as a multi-byte encoding: runs that can be encoded and give valid UTF-8, with losses at the ends."""
    try:
        raw = token.replace("�", "\x1a").encode(wrong)
    except UnicodeEncodeError:
        return None
    if not _UTF8.search(raw):
        return None
    text = raw.decode("utf-8", "replace").replace("\x1a", "�")
    lost = text.count("�")
    return text if lost * 4 <= len(text) + 3 and any(ord(c) > 127 and c != "�" for c in text) else None


def undo(token: str, chain: Chain) -> str | None:
    """The token as meant if ``chain`` was the mistake; None if it cannot have been."""
    if chain.right == "utf-8":
        out = _undo_utf8(token, chain.wrong)
        if chain.twice and out is not None:
            out = _undo_utf8(out, chain.wrong)
        return out
    if chain.right in MULTI_BYTE:
        enc = _encoder(chain.wrong)
        try:
            raw = bytes(enc[c] if ord(c) > 127 else ord(c) for c in token)
            out = raw.decode(chain.right)
        except (KeyError, UnicodeDecodeError):
            return None
        return out
    table = _single(chain.wrong, chain.right)
    enc = _encoder(chain.wrong)
    out = []
    for c in token:
        if ord(c) < 128:
            out.append(c)
        elif c in table:
            out.append(table[c])
        elif c in enc:
            out.append(c)
        else:
            return None
    text = "".join(out)
    return text if text != token else None


# ---- The model ---------------------------------------------------------------------------------------


def ngrams(token: str) -> Iterator[str]:
    """Trigrams of a token between spaces."""
    padded = f"  {token} "
    for i in range(len(padded) - 2):
        yield padded[i : i + 3]


class Lower(NamedTuple):
    """Marginals of all trigrams: ``gram, n`` or, of contexts, ``gram, n, distinct continuations``."""

    ctx2: list[tuple[str, int, int]]
    bi: list[tuple[str, int]]
    ctx1: list[tuple[str, int, int]]
    uni: list[tuple[str, int]]


class Model:
    """Interpolated Witten-Bell trigram model over characters.

    Built from trigram counts alone; lower orders are their marginals, and what none has seen shares the
    Unicode range evenly. Where rare trigrams are left out, ``lower`` has the marginals of all of them, and what is
    left out of a context is shared out by the order below.
    """

    def __init__(self, trigrams: Iterable[tuple[str, int]], lower: Lower | None = None):
        self.tri: dict[str, int] = {}
        self.ctx2: Counter = Counter()
        self.types2: Counter = Counter()
        self.bi: Counter = Counter()
        self.ctx1: Counter = Counter()
        self.types1: Counter = Counter()
        self.uni: Counter = Counter()
        for gram, n in trigrams:
            self.tri[gram] = n
            self.ctx2[gram[:2]] += n
            self.types2[gram[:2]] += 1
            self.bi[gram[1:]] += n
            self.uni[gram[2]] += n
        for gram, n in self.bi.items():
            self.ctx1[gram[0]] += n
            self.types1[gram[0]] += 1
        self.rest2: Counter = Counter()
        self.rest1: Counter = Counter()
        if lower:
            kept = self.ctx2
            self.ctx2, self.types2 = (Counter({g: x[i] for g, *x in lower.ctx2}) for i in (0, 1))
            self.ctx1, self.types1 = (Counter({g: x[i] for g, *x in lower.ctx1}) for i in (0, 1))
            self.bi, self.uni = Counter(dict(lower.bi)), Counter(dict(lower.uni))
            self.rest2 = self.ctx2 - kept
            kept = Counter()
            for gram, n in self.bi.items():
                kept[gram[0]] += n
            self.rest1 = self.ctx1 - kept
        self.total = sum(self.uni.values())
        self.types = len(self.uni)
        self._cache: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        got = self._cache.get(gram)
        if got is not None:
            return got
        p = (self.uni.get(gram[2], 0) + self.types / 150_000) / (self.total + self.types) if self.total else 1 / 150_000
        n, t = self.ctx1.get(gram[1], 0), self.types1.get(gram[1], 0)
        if n:
            p = (self.bi.get(gram[1:], 0) + (t + self.rest1.get(gram[1], 0)) * p) / (n + t)
        n, t = self.ctx2.get(gram[:2], 0), self.types2.get(gram[:2], 0)
        if n:
            p = (self.tri.get(gram, 0) + (t + self.rest2.get(gram[:2], 0)) * p) / (n + t)
        out = math.log(p)
        if len(self._cache) < 500_000:
            self._cache[gram] = out
        return out

    def score(self, token: str) -> float:
        return sum(map(self.logp, ngrams(token)))


# ---- Decisions ---------------------------------------------------------------------------------------


class Verdict(NamedTuple):
    evidence: float
    chain: Chain | None
    restored: str | None
    lost: bool
    """Whether characters were lost for good."""


class Detector:
    """Finds garbled tokens of texts and puts them right.

    Evidence of a chain is summed over the tokens of a line for one-byte chains, gains and losses alike, as
    such a mistake hits every character; for UTF-8 chains, whose sequences hardly occur by chance, over the
    tokens that gain. A text is garbled if one chain's evidence exceeds ``margin`` somewhere.
    """

    def __init__(self, model: Model, margin: float, candidates: list[Chain] | None = None):
        self.model, self.margin = model, margin
        self.chains = candidates or chains()
        self._tokens: dict[str, list[tuple[int, float, str]]] = {}
        self._gaining: dict[str, float] = {}
        self._long: dict[str, list[tuple[int, float, str]]] = {}
        plain = {k: c for k, c in enumerate(self.chains) if c.right != "utf-8" and c.right not in MULTI_BYTE}
        self._tables = {k: {ord(a): b for a, b in _single(c.wrong, c.right).items()} for k, c in plain.items()}
        self._letters: dict[str, tuple[int, int]] = {}
        self._bytes: dict[str, tuple[int, int]] = {}

    def _attested(self, token: str) -> bool:
        """Whether the clean records know every letter. One-byte mistakes and read double bytes always give some
        text; one of letters never seen is no better than what stands there."""
        return all(ord(c) < 128 or self.model.uni.get(c, 0) > 0 for c in token)

    @staticmethod
    def _holed(token: str, fixed: str) -> bool:
        """Whether a letter within a word would become a mark; only apostrophes and hyphens stand there."""
        return any(
            a != b and a.isalpha() and not b.isalpha() and b not in _WITHIN and token[i - 1 : i].isalpha() and token[i + 1 : i + 2].isalpha()
            for i, (a, b) in enumerate(zip(token, fixed, strict=True))
        )

    @staticmethod
    def _torn(token: str, chain: Chain) -> bool:
        """Whether a word would change its script in the middle, which no mistake put right leaves behind."""
        return bool((_INSIDE if chain.right in MULTI_BYTE else _BESIDE).search(token))

    def _letter(self, c: str) -> tuple[int, int]:
        """The one-byte chains, as bits, that can have made a letter of known letters, and those that change it."""
        got = self._letters.get(c)
        if got is None:
            can = change = 0
            for k, table in self._tables.items():
                meant = table.get(ord(c))
                if (meant is not None or c in _encoder(self.chains[k].wrong)) and self._attested(meant or c):
                    can |= 1 << k
                    change |= (meant is not None) << k
            got = self._letters[c] = can, change
        return got

    def _byte(self, c: str) -> tuple[int, int]:
        """The chains, as bits, in which a character is read from a byte that begins a sequence of UTF-8, and from one that goes on with it."""
        got = self._bytes.get(c)
        if got is None:
            lead = follow = 0
            for k, chain in enumerate(self.chains):
                if chain.right == "utf-8" and chain.wrong not in MULTI_BYTE:
                    b = _encoder(chain.wrong).get(c, 0)
                    lead |= (0xC2 <= b <= 0xF4) << k
                    follow |= (0x80 <= b <= 0xBF) << k
            got = self._bytes[c] = lead, follow
        return got

    def _gains(self, token: str) -> list[tuple[int, float, str]]:
        got = (self._tokens if len(token) <= KEPT_TOKEN else self._long).get(token)
        if got is None:
            base, got, seen = self.model.score(token), [], {}
            known = all(c <= "\x7f" or c.isalpha() for c in token) and self._attested(token)
            spelled = 0
            for a, b in zip(token, token[1:], strict=False):
                if a > "\x7f" and b > "\x7f":
                    spelled |= self._byte(a)[0] & self._byte(b)[1]
            can, change = -1, 0
            for c in set(token):
                if c > "\x7f":
                    a, b = self._letter(c)
                    can, change = can & a, change | b
            can &= change
            for k, chain in enumerate(self.chains):
                if k in self._tables:
                    fixed = token.translate(self._tables[k]) if can >> k & 1 else None
                elif chain.right == "utf-8" and chain.wrong not in MULTI_BYTE:
                    fixed = undo(token, chain) if spelled >> k & 1 else None
                else:
                    fixed = undo(token, chain)
                if fixed is None:
                    continue
                if k in self._tables and self._holed(token, fixed):
                    continue
                # Words of known letters may spell UTF-8 by chance, where an encoding has letters for its bytes.
                if chain.right == "utf-8" and known and not self._attested(fixed):
                    continue
                if chain.right != "utf-8" and (self._torn(fixed, chain) or not self._attested(fixed)):
                    continue
                gain = seen.get(fixed)
                if gain is None:
                    gain = seen[fixed] = self.model.score(fixed) - base
                got.append((k, gain, fixed))
            if len(token) <= KEPT_TOKEN:
                if len(self._tokens) > 200_000:
                    self._tokens.clear()
                    self._gaining.clear()
                self._tokens[token] = got
            else:
                self._long[token] = got
        return got

    def _most(self, token: str) -> float:
        """The largest gain of any chain by a token, or 0."""
        known = self._gaining.get(token)
        if known is None:
            known = max((gain for _, gain, _ in self._gains(token)), default=0.0)
            known = max(known, 0.0)
            if len(token) <= KEPT_TOKEN:
                self._gaining[token] = known
        return known

    def _bound(self, text: str) -> float:
        """No chain has more evidence in a text than this."""
        return sum([self._most(token) for token in TOKEN.findall(text) if not token.isascii()])

    def judge(self, text: str) -> Verdict:
        if text.isascii():
            return Verdict(0.0, None, None, False)
        self._long.clear()  # of one text only
        best, best_chain = 0.0, None
        out: list[str] = []
        changed = False
        plain = CITED.sub(lambda m: " " * len(m[0]), text)
        lost = "�" in plain
        if (bound := self._bound(plain)) <= self.margin:
            return Verdict(bound, None, None, lost)
        lines = text.split("\n")
        plain_lines = plain.split("\n")
        whole: Counter = Counter()
        per_line = []
        for line in plain_lines:
            sums: Counter = Counter()
            found = []
            for m in TOKEN.finditer(line) if not line.isascii() and self._bound(line) > 0 else ():
                if m[0].isascii():
                    continue
                gains = self._gains(m[0])
                found.append((m, gains))
                hit = {k for k, _, _ in gains}
                for k, gain, _ in gains:
                    if self.chains[k].right == "utf-8":
                        if gain > 0:
                            sums[k] += gain
                    else:
                        sums[k] += gain
                # A token that a one-byte chain cannot have made speaks against it in this line.
                for k in sums:
                    if k not in hit and self.chains[k].right != "utf-8":
                        sums[k] -= 1.0
            per_line.append((found, sums))
            for k, s in sums.items():
                if s > 0:
                    whole[k] += s
        for (found, sums), line in zip(per_line, lines, strict=True):
            ranked = sorted(sums.items(), key=lambda x: (-x[1], -whole[x[0]], x[0]))
            k, s = ranked[0] if ranked else (-1, 0.0)
            if s > best:
                best, best_chain = s, self.chains[k]
            if s <= 0 or whole[k] <= self.margin:
                out.append(line)
                continue
            at, parts = 0, []
            utf8 = self.chains[k].right == "utf-8"
            for m, gains in found:
                options = [(g, f) for kk, g, f in gains if (kk == k or utf8 and self.chains[kk].right == "utf-8") and (g > 0 or not utf8)]
                if options:
                    g, fixed = max(options)
                    parts += [line[at : m.start()], fixed]
                    at, changed = m.end(), True
            out.append("".join(parts) + line[at:])
        if whole:
            k, s = max(whole.items(), key=lambda x: (x[1], -x[0]))
            if s > best:
                best, best_chain = s, self.chains[k]
        if not changed:
            return Verdict(best, best_chain, None, lost)
        restored = "\n".join(out)
        if best_chain is not None and best_chain.right == "utf-8" and best_chain.wrong in ("cp1252", "latin-1"):
            # C3 A0 whose no-break space was later made a plain space
            restored = re.sub(r"(?<![A-Za-z])Ã (?= ?\w)|(?<=\w)Ã (?= )", "à", restored)
        return Verdict(best, best_chain, restored, lost or "�" in restored)
