"""Operator 4: personal data by weak supervision.

Base spans (emails, IPv4 addresses, payment cards, international phone numbers) are found by their
patterns and checks and always stay. Further candidates (local phone numbers, social security numbers,
IBANs, spelled-out emails, names after a title) are only kept if the final span classifier says so:
regex, gazetteer and context labelers vote on every candidate of the corpus, expectation-maximisation
over the counts of their vote patterns estimates each labeler's reliability without any gold label, and
a logistic span classifier is trained on the resulting probabilities.

What reaches the driver is bounded: the counts of vote patterns (3**6 a kind at most) and a sample of
TRAIN_SPANS candidates (by hash). Everything else runs once over every text, in slices.

Defined results: null and empty texts have no spans (and the digest of the empty string); repeated rows
get a row each; empty tables give no rows; without candidates no span is added. Of added candidates that overlap, the
kind listed first wins, then the one further left; base spans that overlap all stay, and are redacted as one. Texts of
any length are read whole, in time in proportion to it. Spans are code points, end exclusive. Columns named by `keep` that
clash with a result's are passed on with `_in` at the end of their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Taken, by_texts, mapped, renamed, replaced, stored, table
from .features import sigmoid

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("tel", "ssn", "iban", "email_at", "name")
KINDS = BASE_KINDS + MORE_KINDS
TRAIN_SPANS = 4000
ACCEPT = 0.7
_DIMS = 1 << 12

# Patterns of the base kinds (fixed values of the contract). An email is searched from its @, an IPv4
# address from the start of a run of digits: the same matches, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MORE = {
    "tel": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])", re.A),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "email_at": re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]+)+", re.A),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Srta|Mme|Mlle|M)\.? ((?:[^\W\d_a-zß-öø-ÿ][^\W\d_A-ZÀ-ÖØ-Þ]{1,20}(?:['’-][^\W\d_]{2,20})?)(?: (?:(?:van|von|de|del|da|di|la|le) )?[^\W\d_a-zß-öø-ÿ][^\W\d_A-ZÀ-ÖØ-Þ]{1,20}(?:['’-][^\W\d_]{2,20})?){1,2})(?!\w)"),
}
_CUES = (b"[at]", b"(at)", b"[ at", b"( at", b"Mr", b"Ms", b"Miss", b"Dr", b"Prof", b"Herr ", b"Frau ", b"Sr", b"Mme", b"Mlle", b"M ", b"M. ")
_FLAGGED = tb.byte_set(b"@", ((0x30, 0x39),))

# Gazetteers (fixed values): top-level domains beside those of two letters, calling codes, common first names of four
# languages, countries with IBANs.
_TLDS = frozenset("com org net edu gov mil int info biz name pro mobi aero coop museum travel jobs app dev cloud online site store shop blog tech xyz agency email".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NAMES = frozenset(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven andrew paul joshua kenneth kevin brian george timothy
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley emily donna michelle carol amanda melissa laura anna julia emma olivia
    jean pierre michel andré philippe alain bernard jacques nicolas françois marie jeanne françoise monique catherine nathalie isabelle sylvie luc sophie claire camille hélène
    hans peter klaus wolfgang jürgen dieter manfred uwe günther stefan andreas ursula monika petra elisabeth sabine renate helga karin brigitte ingrid jonas lukas felix
    antonio josé manuel francisco juan javier carlos miguel luis pedro pablo maria carmen ana isabel dolores pilar teresa rosa lucía sofía elena marta raúl""".split()
)
_IBAN_LANDS = frozenset("DE FR ES IT NL GB CH AT BE LU PT IE PL SE DK NO FI CZ".split())
# Context words (fixed values).
_FOR = {
    "email": ("mail", "contact", "correo", "courriel"), "email_at": ("mail", "contact", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "whatsapp"), "tel": ("tel", "phone", "call", "fax", "mobil", "ring"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "konto", "bank", "compte", "cuenta"), "name": ("name", "contact", "signed", "patient", "client"),
}
_AGAINST = ("version", "isbn", "issn", "release", "build", "order", "invoice", "serial", "chapter", "section", "doi", "example of")


def _known_domain(name: str) -> bool:
    return name in _TLDS or len(name) == 2 and name.isalpha()


def _part(p: str) -> bool:
    """A part of an IPv4 address; leading zeros may be many."""
    own = p.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, begin, at = [], 0, text.find("@")
    while at >= 0:
        part = text[begin:at]
        local = len(part) - len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        begin = at + 1
        if m:
            out.append((at - local, m.end()))
            begin = m.end()
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def more_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the other kinds that touch no base span and none before them."""
    out: list[tuple[int, int, str]] = []
    taken = Taken([(a, b) for a, b, _ in base])
    for kind, pattern in _MORE.items():
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "name" else m.span()
            if taken.add(a, b):
                out.append((a, b, kind))
    return sorted(out)


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Each labeler says 1 (personal), -1 (not) or 0 (abstains)."""
    value, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    digits = re.sub(r"[^0-9]", "", value)
    # regex: the strict form of the kind
    form = {
        "email": lambda: 1 if re.fullmatch(r"[A-Za-z0-9][\w.+-]*@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,10}", value, re.A) else -1,
        "email_at": lambda: 1 if re.search(r"[\])] ?[A-Za-z]{2,10}$", value) else -1,
        "ip": lambda: 1 if all(p == "0" or p[0] != "0" for p in value.split(".")) else -1,
        "card": lambda: 1 if len(digits) in (13, 14, 15, 16, 19) else -1,
        "phone": lambda: 1 if 10 <= len(digits) <= 13 else -1,
        "tel": lambda: 1 if digits[0] not in "01" and digits[3] not in "01" else -1,
        "ssn": lambda: -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1,
        "iban": lambda: 1 if _iban_ok(value) else -1,
        "name": lambda: 1 if value.count(" ") == 1 else 0,
    }[kind]()
    # gazetteer
    known = {
        "email": lambda: 1 if _known_domain(value.rpartition(".")[2].lower()) else 0,
        "email_at": lambda: 1 if _known_domain(re.split(r"\W+", value.lower())[-1]) else 0,
        "ip": lambda: -1 if value.startswith(("0.", "127.", "255.")) else 0,
        "card": lambda: 1 if digits[0] in "3456" else -1,
        "phone": lambda: 1 if any(digits[:n] in _CALLING for n in (1, 2)) else -1,
        "tel": lambda: -1 if len(set(digits)) < 3 else 0,
        "ssn": lambda: -1 if digits in ("123456789", "078051120") else 0,
        "iban": lambda: 1 if value[:2] in _IBAN_LANDS else -1,
        "name": lambda: 1 if any(p in _NAMES for p in re.split(r"[ '’-]", value.lower())) else 0,
    }[kind]()
    near = 1 if any(w in before for w in _FOR[kind]) else 0
    against = -1 if any(w in before for w in _AGAINST) else 0
    touching = (before[-1:].isalnum() or before[-1:] in ("_", "/", "=")) or (after[:1].isalnum() or after[:1] == "_")
    edge = -1 if touching else 1 if (not before or before[-1] in " \n(:<\"'") and (not after or after[0] in " \n).,;>\"'?!") else 0
    dull = -1 if digits and (len(set(digits)) <= 2 and len(digits) > 6 or digits in "01234567890123456789") else 0
    return form, known, near, against, edge, dull


def _features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashed facts about a span and its neighbourhood for the final classifier."""
    value = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), value))[:40]
    around = [f"b:{w}" for w in re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-3:]]
    facts = [f"k:{kind}", f"s:{kind}:{shape}", f"l:{kind}:{min(len(value) // 4, 12)}", f"p:{kind}:{text[start - 1 : start]!r}", f"n:{kind}:{text[end : end + 1]!r}", *(f"v:{kind}:{i}:{v}" for i, v in enumerate(votes(text, start, end, kind))), *around]
    return [int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % _DIMS for f in facts]


def reliabilities(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 100) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of 'personal' for each (kind, votes), by expectation-maximisation over two hidden classes.
    Every labeler has, for each class, a smoothed distribution over its three votes; every kind its own prior."""
    if not patterns:
        return {}
    keys = list(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    vote = np.array([k[1] for k in keys]) + 1
    kinds = sorted({k[0] for k in keys})
    kind = np.array([kinds.index(k[0]) for k in keys])
    m = vote.shape[1]
    p = sigmoid(1.5 * (vote - 1).sum(axis=1))  # starts from the majority of votes
    for _ in range(rounds):
        old = p
        prior = np.array([(counts[kind == k] @ p[kind == k] + 1) / (counts[kind == k].sum() + 2) for k in range(len(kinds))])
        score = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(m):
            for v in range(3):
                on = vote[:, j] == v
                good = (counts[on] @ p[on] + (2, 2, 4)[v]) / (counts @ p + 8)
                bad = (counts[on] @ (1 - p[on]) + (4, 2, 2)[v]) / (counts @ (1 - p) + 8)
                score[on] += np.log(good / bad)
        p = sigmoid(score)
        if np.abs(p - old).max() < 1e-6:
            break
    return dict(zip(keys, p.tolist(), strict=True))


class SpanClassifier:
    """Logistic regression over hashed facts, trained on probabilities."""

    def __init__(self, rows: list[list[int]], target: list[float], rounds: int = 80) -> None:
        self.weights, self.bias = np.zeros(_DIMS), 0.0
        self.trained = bool(rows)
        if not rows:
            return
        at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        y, square = np.array(target), np.full(_DIMS, 1e-9)
        for _ in range(rounds):
            error = (sigmoid(np.bincount(row, weights=self.weights[at], minlength=len(rows)) + self.bias) - y) / len(rows)
            grad = np.bincount(at, weights=error[row], minlength=_DIMS) + 1e-5 * self.weights
            square += grad * grad
            self.weights -= 0.3 * grad / np.sqrt(square)

    def accepts(self, text: str, start: int, end: int, kind: str) -> bool:
        return self.trained and float(sigmoid(self.weights[_features(text, start, end, kind)].sum() + self.bias)) >= ACCEPT


def flagged(texts: tb.Texts) -> np.ndarray:
    """Numbers of the texts that can hold a span: those with an @, a digit or a cue."""
    flags = texts.count(_FLAGGED) > 0
    raw = texts.data.tobytes()
    for cue in _CUES:
        at = raw.find(cue)
        while at >= 0:
            d = int(np.searchsorted(texts.offsets, at, "right")) - 1
            flags[d] = True
            at = raw.find(cue, max(at + 1, int(texts.offsets[d + 1]) - len(cue)))
    return np.flatnonzero(flags)


def fit(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Votes on every candidate of the corpus, then reliabilities, then the classifier."""

    def run(batches):
        for batch in batches:
            for _, _, texts in tb.slices(batch.column(0)):
                kinds, codes, facts, order = [], [], [], []
                for d in flagged(texts).tolist():
                    t = texts.text(d)
                    base = base_spans(t)
                    for a, b, kind in (*base, *more_candidates(t, base)):
                        kinds.append(kind)
                        codes.append(sum((v + 1) * 3**i for i, v in enumerate(votes(t, a, b, kind))))
                        facts.append(_features(t, a, b, kind))
                        order.append(int.from_bytes(hashlib.blake2b(f"{kind}\0{t[max(0, a - 20) : b + 20]}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(codes, pa.int32()), pa.array(facts, pa.list_(pa.int32())), pa.array(order, pa.int64())], names=["kind", "code", "facts", "place"])

    spans = stored(mapped(docs.select(F.col(f"`{text}`").cast("string").alias("__text")), run, "kind string, code int, facts array<int>, place bigint"), "candidates")
    counted = spans.groupBy("kind", "code").count().toArrow().to_pylist()
    unpack = lambda code: tuple(code // 3**i % 3 - 1 for i in range(6))
    believed = reliabilities({(r["kind"], unpack(r["code"])): r["count"] for r in counted})
    # half of the sample by hash is of base kinds, half of the others
    picked = [spans.where(F.col("kind").isin(*kinds)).dropDuplicates(["place", "code"]).orderBy("place", "kind", "code").limit(TRAIN_SPANS // 2) for kinds in (BASE_KINDS, MORE_KINDS)]
    sample = picked[0].union(picked[1]).toArrow().to_pylist()
    return SpanClassifier([r["facts"] for r in sample], [believed[r["kind"], unpack(r["code"])] for r in sample])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_EMPTY = hashlib.sha256(b"").hexdigest()


def find(docs: DataFrame, model: SpanClassifier, keep: list[str], text: str = "text") -> DataFrame:
    """Counts and spans by document; `redacted` is null where nothing was found."""

    def work():
        def of(texts: tb.Texts, n: int) -> dict:
            out: dict[str, list] = {f"n_{k}": [0] * n for k in BASE_KINDS}
            out |= {"base_sha256": [_EMPTY] * n, "spans": [""] * n, "redacted": [None] * n}
            for d in flagged(texts).tolist():
                t = texts.text(d)
                base = base_spans(t)
                added = [s for s in more_candidates(t, base) if model.accepts(t, *s)]
                if not base and not added:
                    continue
                for k in BASE_KINDS:
                    out[f"n_{k}"][d] = sum(s[2] == k for s in base)
                out["base_sha256"][d] = hashlib.sha256(joined(base).encode()).hexdigest()
                every = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))
                out["spans"][d] = joined(every)
                out["redacted"][d] = redact(t, every)
            return out

        return of

    return by_texts(docs, keep, text, ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string, redacted string", work)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in `text` (n_chars follows); no row goes."""
    own, named = renamed(docs)
    return replaced(docs, find(own, fit(docs), own.columns, named["text"]), named, "redacted")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs), ["doc_id"]).drop("redacted")
