"""Problem 3: credentials in source text, found corpus-wide and redacted.

1. Every text is searched for literals that stand where a credential can stand (``credential_rules``);
   rows that cannot hold one are dropped in the JVM.
2. The literals are indexed over the whole corpus: per literal the number of owners (repositories). What
   many owners share is a placeholder or a published example; the rare ones are confirmed.
3. Every text is scanned again for the confirmed secrets, so that a secret is found also where nothing around
   it says what it is: with one Aho-Corasick automaton while all of them fit ``AUTOMATON_CHARS``. A larger set is
   never sent anywhere: the texts' windows that a Bloom filter of fixed size lets pass are joined with the
   secrets' last characters and compared exactly. Either way it is one pass over the texts, with equal results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import credential_rules as rules
from codestrata.session import broadcast_if_small, cut

#: A literal of more owners than this is no secret, unless its format alone says that it was issued.
MAX_OWNERS = 5
#: Characters of secrets in an automaton (about 40 bytes of memory each).
AUTOMATON_CHARS = 1_000_000
#: Shorter literals are not searched for without their context, nor are those under ``MIN_PLAIN`` that are a mere
#: word or number: nothing tells them from other uses of the word.
MIN_RESCAN, MIN_PLAIN = 6, 8
#: Bits of the filter for each secret, their positions, and the most bits of all (32 MB).
BITS_EACH, PROBES, MOST_BITS = 32, 3, 1 << 28
# ---- Fixed values: marks of credentials that vendors publish as examples ----
PUBLISHED = ["EXAMPLE", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwI"]
# -----------------------------------------------------------------------------

_CANDIDATES = (
    "tbl string, row_key bigint, th bigint, repo string, line_no int, value string, evidence string, signature string, skip int, "
    "spans array<struct<s int, e int>>"
)
#: What every text with a candidate holds, in lower case.
_MARKS = [
    "pass", "pwd", "pw", "secret", "token", "key", "credential", "authorization", "kennwort", "contrase", "senha", "haslo", "hasło", "heslo", "losenord",
    "lösenord", "wachtwoord", "parola", "пароль", "clave", "://", "basic", "bearer", "-u", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_",
    "glpat-", "xox", "_live_", "sg.", "hvs.", "hvb.", "aiza", "npm_", "pypi-", "eyj",
]


def texts_of(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Both tables as ``tbl, row_key, repo, text, th``; ``th`` tells the texts of a key that was delivered twice apart."""
    a = files.select(F.lit("files").alias("tbl"), F.col("file_id").alias("row_key"), "repo", F.col("content").alias("text"))
    b = findings.select(F.lit("findings").alias("tbl"), F.col("row_id").alias("row_key"), "repo", F.col("code_snippet").alias("text"))
    return a.unionByName(b).filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("th", F.xxhash64("text"))


def _candidates(text: str) -> list[tuple]:
    """``line_no, value, evidence, signature, skip, spans`` of the candidates of one text."""
    out, line, at = [], 1, 0
    for c in sorted(rules.candidates(text)):
        line, at = line + text.count("\n", at, c.start), c.start
        # A literal in pieces is known elsewhere by the source of its first line.
        signature, skip = c.value, 0
        if c.pieces:
            begin, stop = text.rfind("\n", 0, c.start) + 1, text.find("\n", c.start)
            begin += len(text[begin : c.start]) - len(text[begin : c.start].lstrip())
            signature, skip = text[begin : min(stop if stop >= 0 else c.end, c.end)].rstrip(), c.start - 1 - begin
        elif c.value.startswith("-----BEGIN"):
            signature = ""
        spans = [{"s": a, "e": b} for a, b in c.pieces or ((c.start, c.end),)]
        out.append((line, c.value, c.evidence, signature, skip, spans))
    return out


def extract(texts: DataFrame) -> DataFrame:
    """Candidate literals of every text (``_CANDIDATES``)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["tbl", "row_key", "th", "repo", "line_no", "value", "evidence", "signature", "skip", "spans"]
        for pdf in batches:
            out, known = [], {}
            for tbl, key, th, repo, text in zip(pdf["tbl"], pdf["row_key"], pdf["th"], pdf["repo"], pdf["text"], strict=True):
                if th not in known:
                    known[th] = text, _candidates(text)
                found = known[th][1] if known[th][0] == text else _candidates(text)
                out += [(tbl, key, th, repo, *c) for c in found]
            if out:
                yield pd.DataFrame(out, columns=columns)

    low = F.lower("text")
    some = F.lit(False)
    for mark in _MARKS:
        some = some | F.contains(low, F.lit(mark))
    return texts.filter(some).mapInPandas(walk, _CANDIDATES)


def published(value: Column | str) -> Column:
    """Whether a literal is one of the examples that vendors publish."""
    return F.exists(F.array(*[F.lit(p) for p in PUBLISHED]), lambda p: F.contains(F.col(value) if isinstance(value, str) else value, p))


def confirmed(candidates: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``value, owners, p, skip``: the literals that are secrets, once for each text they are known by.

    Those are the literals of at most ``max_owners`` owners (a null repository is an owner of its own) and, whatever
    their owners, the structured ones that are no published example.
    """
    owned = candidates.select("value", F.coalesce("repo", F.lit("")).alias("repo"), (F.col("evidence") == "structured").alias("issued")).distinct()
    per = owned.groupBy("value").agg(F.countDistinct("repo").alias("owners"), F.bool_or("issued").alias("issued"))
    secret = per.filter((F.col("owners") <= max_owners) | F.col("issued") & ~published("value")).select("value", "owners")
    forms = candidates.select("value", F.explode(F.array(F.struct(F.col("signature").alias("p"), "skip"), F.struct(F.col("value").alias("p"), F.lit(0).alias("skip")))).alias("f"))
    forms = forms.select("value", "f.p", "f.skip").filter(~F.startswith("p", F.lit("-----BEGIN"))).distinct()
    return secret.join(forms, "value", "left")


_automata: dict = {}


def _automaton(key, patterns: list[tuple[str, int]]):
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        auto = ahocorasick.Automaton()
        for p, skip in patterns:
            auto.add_word(p, (p, skip))
        auto.make_automaton()
        _automata[key] = auto
    return _automata[key]


def _occurrences(auto, text: str) -> Iterator[tuple[int, int]]:
    for last, (pattern, skip) in auto.iter(text):
        start, end = last - len(pattern) + 1, last + 1
        if start and pattern[0].isalnum() and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        if end < len(text) and pattern[-1].isalnum() and (text[end].isalnum() or text[end] == "_"):
            continue
        yield start + skip, end


def patterns_of(secrets: DataFrame) -> DataFrame:
    """``p, skip``: what is searched for in every text."""
    plain = F.col("p").rlike(r"^(?:\p{L}+|\d+)$")
    some = secrets.filter((F.length("p") >= MIN_PLAIN) | (F.length("p") >= MIN_RESCAN) & ~plain)
    return some.groupBy("p").agg(F.max("skip").alias("skip"))


def rescan(texts: DataFrame, secrets: DataFrame, block_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``tbl, row_key, th, line_no, spans`` of every occurrence of a confirmed secret in any text."""
    known = cut(patterns_of(secrets))
    total = known.agg(F.sum(F.length("p"))).first()[0] or 0
    return _by_automaton(texts, known) if total <= block_chars else _by_windows(texts, known)


def _by_automaton(texts: DataFrame, known: DataFrame) -> DataFrame:
    patterns = texts.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in known.collect()])
    mark = uuid.uuid4().hex  # what a reused worker knows the automaton by
    schema = "tbl string, row_key bigint, th bigint, line_no int, spans array<struct<s int, e int>>"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton(mark, patterns.value) if patterns.value else None
        for pdf in batches:
            rows = []
            for tbl, key, th, text in zip(pdf["tbl"], pdf["row_key"], pdf["th"], pdf["text"], strict=True):
                line, at = 1, 0
                for s, e in sorted(_occurrences(auto, text)) if auto else ():
                    line, at = line + text.count("\n", at, s), s
                    rows.append((tbl, key, th, line, [{"s": s, "e": e}]))
            if rows:
                yield pd.DataFrame(rows, columns=["tbl", "row_key", "th", "line_no", "spans"])

    return texts.select("tbl", "row_key", "th", "text").mapInPandas(walk, schema)


# ---- Windows: the way for sets of any size -----------------------------------------------------------
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


#: Characters of texts that are hashed at once.
_GROUP_CHARS = 1_000_000


def _width(length: int) -> int:
    """Characters at the end of a pattern that find it: all of a short one, at least half of any."""
    if length < 12:
        return length
    width = 12
    while 2 * width <= length:
        width *= 2
    return width


class _Windows:
    """Hashes of all windows of some texts, as differences of a running sum."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts)
        self.chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.lines = np.concatenate([[0], np.cumsum(self.chars == 10)])
        codes, n = self.chars.astype(np.uint64), len(self.chars)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes * _MIX[0] + np.uint64(1)) * power[:n])])
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else sizes

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Places behind which a pattern can end, no space and not within a run of plain letters and digits, and their texts."""
        c = self.chars
        letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128) | (c >= 48) & (c <= 57)
        inside = letter & np.concatenate([(letter | (c == 95))[1:], [False]])
        ends = np.flatnonzero(~inside & (c > 32))
        return ends + 1, np.searchsorted(self.starts, ends, "right") - 1

    def hashes(self, ends: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[ends - width]) * self.inverse[ends - width] + np.uint64(width)
            h ^= h >> np.uint64(31)
            h *= _MIX[1]
            return h ^ (h >> np.uint64(29))


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of hashes in the filter."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(2 * k + 1) * _MIX[0]
    return (x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)


def _by_windows(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The same occurrences by a join: no part of the secrets is collected but the bits of the filter.

    A text's windows that end where a pattern can end are looked up in the filter; those that pass go with twice
    their width of text to the patterns of their hash, where they are compared exactly.
    """

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = _Windows(list(pdf["p"]))
            widths = np.array([_width(len(p)) for p in pdf["p"]], dtype=np.int64)
            ends = w.starts + np.array([len(p) for p in pdf["p"]], dtype=np.int64)
            h = np.empty(len(pdf), np.uint64)
            for width in np.unique(widths):
                h[widths == width] = w.hashes(ends[widths == width], int(width))
            yield pdf[["p", "skip"]].assign(h=h.view(np.int64), width=widths)

    hashed = cut(known.mapInPandas(marks, "p string, skip int, h bigint, width int"))
    bits = 1 << 16
    count = hashed.count()
    while bits < MOST_BITS and bits < count * BITS_EACH:
        bits *= 2
    widths = [r[0] for r in hashed.select("width").distinct().collect()]  # a logarithm of the longest pattern, and few

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.concatenate([_probe(pdf["h"].to_numpy(np.int64).view(np.uint64), k, bits) for k in range(PROBES)]).astype(np.int64)
            yield pd.DataFrame({"word": at >> 5, "bit": np.int64(1) << (at & 31)})

    grouped = hashed.select("h").mapInPandas(words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(bits // 32, np.uint32)
    set_words = grouped.toPandas()  # at most MOST_BITS / 32 words
    table[set_words["word"].to_numpy(np.int64)] = set_words["bit"].to_numpy(np.int64).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group = np.cumsum(pdf["text"].str.len().to_numpy(np.int64)) // _GROUP_CHARS
            for _, part in pdf.groupby(group, sort=False):
                w = _Windows(list(part["text"]))
                at, doc, h, width = [], [], [], []
                ends, d = w.ends()
                for size in widths:
                    ok = ends - w.starts[d] >= size
                    e, i = ends[ok], d[ok]
                    x = w.hashes(e, size)
                    for k in range(PROBES):
                        b = _probe(x, k, bits)
                        hit = (shared.value[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                        e, i, x = e[hit], i[hit], x[hit]
                    at.append(e), doc.append(i), h.append(x), width.append(np.full(len(x), size))
                at, doc, h, width = (np.concatenate(x) for x in (at, doc, h, width))
                if not len(at):
                    continue
                low = w.starts[doc]
                out = part[["tbl", "row_key", "th"]].iloc[doc].reset_index(drop=True)
                out["h"], out["e"] = h.view(np.int64), at - low
                out["line"] = w.lines[at] - w.lines[low] + 1
                out["before"] = [w.text[max(s, e - 2 * k) : e] for s, e, k in zip(low, at, width, strict=True)]
                out["after"] = [w.text[e : e + 1] for e in at]
                yield out

    schema = "tbl string, row_key bigint, th bigint, h bigint, e int, line int, before string, after string"
    hits = texts.select("tbl", "row_key", "th", "text").mapInPandas(probe, schema)
    letter, word = r"[\p{L}\p{N}]", r"^[\p{L}\p{N}_]"
    n = F.length("p")
    previous = F.expr("substring(before, length(before) - length(p), 1)")
    exact = (
        F.endswith("before", "p")
        & ~((F.length("before") > n) & F.col("p").rlike("^" + letter) & previous.rlike(word))
        & ~(F.col("p").rlike(letter + "$") & F.col("after").rlike(word))
    )
    inner = F.expr("substring(p, skip + 1)")
    start = (F.col("e") - n + F.col("skip")).alias("s")
    line = F.col("line") - (F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit(""))))
    joined = hits.join(broadcast_if_small(hashed, count * 120), "h").filter(exact)
    return joined.select("tbl", "row_key", "th", line.cast("int").alias("line_no"), F.array(F.struct(start, "e")).alias("spans"))


def places(files: DataFrame, findings: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``tbl, row_key, th, line_no, spans``: where the text of a usable credential begins and stands.

    A line number counts lines that end with a line feed, from 1. A text may have several rows for one
    line. Null and empty texts give none; repeated rows give theirs under their own key; texts are never cut.
    """
    texts = texts_of(files, findings)
    found = cut(extract(texts))
    secrets = cut(confirmed(found, max_owners))
    direct = found.join(secrets.select("value"), "value", "left_semi").select("tbl", "row_key", "th", "line_no", "spans")
    return direct.unionByName(rescan(texts, secrets))


def found_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The rows of p3_found."""
    return places(files, findings).select("tbl", "row_key", "line_no").distinct()


#: A literal, or the beginning of one that goes on behind the text.
_PIECE = re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*(\1|$)""", re.S)


def _redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the secret parts replaced; quotes, names, line ends and a key's frame stay."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    out, at = [], 0
    for s, e in merged:
        out.append(text[at:s])
        secret = text[s:e]
        if secret.startswith("-----BEGIN") and (head := rules.PEM.match(secret)):
            tail = rules.PEM_END.search(secret)
            body = secret[head.end() : tail.start() if tail else len(secret)]
            out.append(head[0] + rules.KEY_BODY.sub("REDACTED", body) + (tail[0] if tail else ""))
        elif secret[:1] in "\"'`":  # the source of a literal in pieces
            out.append(_PIECE.sub(r"\1REDACTED\2", secret))
        else:
            out.append("REDACTED")
        at = e
    out.append(text[at:])
    return "".join(out)


def redacted(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``tbl, row_key, redacted``: every text that holds a credential, with only the secret parts replaced."""
    key = ["tbl", "row_key", "th"]
    where = cut(places(files, findings).groupBy(*key).agg(F.flatten(F.collect_set("spans")).alias("spans")))
    size = where.agg(F.sum(F.size("spans") * 16 + 64)).first()[0] or 0
    rows = texts_of(files, findings).select(*key, "text").join(broadcast_if_small(where, size), key)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean = [_redact(t, [(x["s"], x["e"]) for x in spans]) for t, spans in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pd.DataFrame({"tbl": pdf["tbl"], "row_key": pdf["row_key"], "redacted": clean})

    return rows.mapInPandas(walk, "tbl string, row_key bigint, redacted string")
