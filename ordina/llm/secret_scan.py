"""Operator 10: secrets.

Base spans (assignments to credential names, access key ids, long hexadecimal runs) are found by their
patterns. Values in credential context that no base span touches (shorter ones, or after other names)
are judged by what it costs to guess them: the cheapest segmentation into known words, dates, repeats,
sequences, keyboard walks and brute-force spans, found by dynamic programming. Values that take more
than 10**GUESSES guesses are added as kind `guess`; the cost decides, but for two gates: references such as
$NAME, ${...}, {{...}} or %NAME% are no values, and after the word `is` (prose) a value needs two character classes.

Words are those of public tokenizer vocabularies, ranked by their merges (their paths are parameters), after a short
list of common passwords. Repeats, sequences and walks have SEGMENT characters at most, or all of their run if they start
with it, so the programme looks at a bounded stretch of a value and the value itself has no bound.

Defined results: null and empty texts have no spans (and the digest of the empty string); repeated rows
get a row each; an empty table gives no rows; base spans that overlap all stay; a value whose cost is just the limit is
none; texts and values of any length are read whole, in time in proportion to it. Spans are code points, end
exclusive. Columns named by `keep` that clash with a result's are passed on with `_in` at the end of their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import textbytes as tb
from .common import Taken, by_texts, table

KINDS = ("assign", "access", "hex")
GUESSES = 8.0

# Patterns of the base kinds (fixed values of the contract).
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|auth(?:[_ -]?(?:key|token))?|private[_ -]?key|credentials?|passwort|contraseña|mot de passe"
# a name starts after no letter, or with a capital after a small letter (dbPassword)
_CONTEXT = re.compile(rf"""(?:(?<![A-Za-z])(?i:{_NAME})|(?<=[a-z])(?=[A-Z])(?i:{_NAME}))["']?(?:(?P<prose> is )|\x20*(?::|=>?)\x20*)["'`]?(?P<value>[^\s"'`,;<>]+)""", re.A)
_REFERENCE = re.compile(r"\$\{?[\w.]+\}?|\$?\{\{?.*\}|%\w+%|%\(\w+\)s")
_CUES = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"api key", b"auth", b"private", b"credential", "contraseña".encode())
_HEX_BYTES = tb.byte_set(b"abcdef", ((0x30, 0x39),))

# Common passwords by rank (fixed values).
_PASSWORDS = "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 abc123 monkey letmein shadow master 666666 iloveyou 123321 superman 654321 secret admin welcome login sunshine princess football baseball michael changeme default root test user guest example none null true false your here value string token password123 passw0rd".split()
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SEGMENT, LONGEST_WORD = 64, 24
_KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4310$57@", "aeiosst" + "a")
_CLASSES = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for y, row in enumerate(_KEYS):
        for x, c in enumerate(row):
            out[c] = {_KEYS[b][a] for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if 0 <= b < len(_KEYS) and 0 <= a < len(_KEYS[b]) and (a, b) != (x, y)}
    return out


_NEXT_TO = _neighbours()
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)[0-9]{2}|[0-9]{2})")


def ranked_words(paths: tuple[str, ...] = VOCABULARIES) -> dict[str, int]:
    """Words of three letters or more by rank: common passwords, then the pieces of the vocabularies in the order of their merges."""
    out = {w: i + 1 for i, w in enumerate(_PASSWORDS)}
    for path in paths:
        with open(path, "rb") as f:  # noqa: PTH123
            for line in f:
                piece, rank = line.split()
                word = base64.b64decode(piece).decode("utf-8", "ignore").strip().lower()
                if 3 <= len(word) <= LONGEST_WORD and word.isalpha():
                    at = len(_PASSWORDS) + int(rank) + 1
                    if at < out.get(word, at + 1):
                        out[word] = at
    return out


def run_ends(low: str, i: int, period: int) -> int:
    """The end of the run from i in which every character equals the one `period` before."""
    j = i + period
    while j < len(low) and low[j] == low[j - period]:
        j += 1
    return j


def segments(value: str, low: str, i: int, words: dict[str, int], most: int) -> Iterator[tuple[int, float]]:
    """(end, log10 of guesses) of all segments that start at i; brute force takes `most` characters at most."""
    n = len(value)
    for j in range(i + 1, min(n, i + most) + 1):  # brute force: ten guesses a character
        yield j, float(j - i)
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):  # words, plain, capitalised or with look-alike digits
        part = low[i:j]
        rank = words.get(part)
        if rank is None and (rank := words.get(part.translate(_LEET))) is not None:
            rank *= 4
        if rank is not None:
            yield j, math.log10(rank + 1) + (0.3 if value[i:j] != part else 0.0)
    if m := _DATE.match(value, i):
        yield m.end(), 4.6 if len(m[0]) > 4 else 2.1
    for size in range(1, 5):  # repeats of a block of one to four characters
        begins = i == 0 or i - 1 + size >= n or low[i - 1] != low[i - 1 + size]
        end = run_ends(low, i, size) if begins else run_ends(low[i : i + SEGMENT], 0, size) + i
        whole = i + (end - i) // size * size
        for j in (*range(i + 2 * size, min(whole, i + SEGMENT) + 1, size), *((whole,) if whole > i + SEGMENT else ())):
            yield j, size + math.log10((j - i) // size)
    if i + 2 < n and abs(step := ord(low[i + 1]) - ord(low[i])) == 1:  # sequences by a fixed step
        j = i + 2
        begins = i == 0 or ord(low[i]) - ord(low[i - 1]) != step
        while j < n and ord(low[j]) - ord(low[j - 1]) == step and (begins or j - i < SEGMENT):
            j += 1
            if j - i <= SEGMENT:
                yield j, 1.0 + math.log10(j - i)
        if j - i > SEGMENT:
            yield j, 1.0 + math.log10(j - i)
    j = i + 1  # walks over neighbouring keys
    while j < n and j - i < SEGMENT and low[j] in _NEXT_TO.get(low[j - 1], ()):
        j += 1
        if j - i >= 3:
            yield j, 1.7 + 0.5 * (j - i)


def guess_cost(value: str, limit: float = math.inf, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of the value (infinite if above the limit). Each further
    segment costs a factor, as an attacker tries simple patterns first."""
    if words is None:
        words = _words()
    n, low = len(value), value.lower()
    if len(low) != n:  # letters whose small form is longer
        low = "".join(c.lower()[0] for c in value)
    best = {0: 0.0}
    reached = [0]  # positions on paths within the limit, in order
    while reached:
        i = heapq.heappop(reached)
        if i == n:
            break
        base = best[i] + (0.3 if i else 0.0)
        most = n if limit == math.inf else max(0, math.floor(limit - base))
        for j, cost in segments(value, low, i, words, most):
            own = base + cost
            if own <= limit and own < best.get(j, math.inf):
                if j not in best:
                    heapq.heappush(reached, j)
                best[j] = own
    return best.get(n, math.inf)


@functools.cache
def _words() -> dict[str, int]:
    return ranked_words()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def guessed_spans(text: str, base: list[tuple[int, int, str]], words: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """Values in credential context that are hard to guess and touch no base span."""
    out = []
    taken = Taken([(a, b) for a, b, _ in base])
    for m in _CONTEXT.finditer(text):
        value = m["value"].rstrip(".)]}!?" if m["prose"] else "")
        for opening, closing in ("()", "[]", "{}"):  # brackets around the assignment
            while value.endswith(closing) and value.count(closing) > value.count(opening):
                value = value[:-1]
        a, b = m.start("value"), m.start("value") + len(value)
        if not value or _REFERENCE.fullmatch(value) or taken.touches(a, b):
            continue
        if m["prose"] and sum(any(map(c, value)) for c in _CLASSES) < 2:
            continue
        if guess_cost(value, GUESSES, words) > GUESSES:
            out.append((a, b, "guess"))
    return out


def flagged(texts: tb.Texts) -> np.ndarray:
    """Numbers of the texts with a long hexadecimal run, an access key prefix or a credential word."""
    flags = np.zeros(len(texts), bool)
    runs = tb.runs(_HEX_BYTES[texts.data], texts.offsets)
    flags[np.searchsorted(runs.offsets, np.flatnonzero(runs.ends - runs.starts >= 16), "right") - 1] = True
    plain = texts.data.tobytes()
    lower = tb.LOWER[texts.data].tobytes()
    for raw, cue in [(plain, b"AKIA"), *((lower, c) for c in _CUES)]:
        at = raw.find(cue)
        while at >= 0:
            d = int(np.searchsorted(texts.offsets, at, "right")) - 1
            flags[d] = True
            at = raw.find(cue, max(at + 1, int(texts.offsets[d + 1]) - len(cue)))
    return np.flatnonzero(flags)


_EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, keep: list[str], text: str = "text", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans, by document."""
    words = ranked_words(vocabularies)  # on the driver; a few megabytes, whatever the corpus

    def work():
        def of(texts: tb.Texts, n: int) -> dict:
            out: dict[str, list] = {f"n_{k}": [0] * n for k in KINDS} | {"base_sha256": [_EMPTY] * n, "spans": [""] * n}
            for d in flagged(texts).tolist():
                t = texts.text(d)
                base = base_spans(t)
                every = sorted([*base, *guessed_spans(t, base, words)], key=lambda s: (s[0], (*KINDS, "guess").index(s[2])))
                if every:
                    for k in KINDS:
                        out[f"n_{k}"][d] = sum(s[2] == k for s in base)
                    out["base_sha256"][d] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    out["spans"][d] = _joined(every)
            return out

        return of

    return by_texts(docs, keep, text, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string", work)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), ["doc_id"])
