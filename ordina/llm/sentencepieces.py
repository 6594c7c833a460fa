"""Operator 9: SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text by the sum of piece scores is found left to right. Open are only positions that a piece
can still reach, at most the longest piece ahead; behind them a trail of back pointers is kept. Whenever all surviving
paths pass one boundary, the ids up to it are committed and the trail up to it is dropped. Scores are integers, and of
equally good paths the one with the shortest last piece wins: the rest of a run then always stands at its end, so the
paths through long runs (of spaces, say) meet a few pieces back. Where nothing can be open (before a space that follows
another character, as pieces hold spaces only in front, and around characters that only byte pieces cover), the stream
has one open position and no trail, and what it does next depends only on the characters up to the next such place:
the ids of short stretches are remembered (a bounded table) and others streamed. Memory therefore follows the distance
between meetings, not the text; a vocabulary can be made whose paths never meet on some text, and then the trail grows.

A space stands for the vocabulary's U+2581 and one is put in front of every text, as in the original
format; a U+2581 that is really in a text becomes bytes, so decode(encode(t)) == t for every text. Characters that no
piece covers become the vocabulary's byte pieces, at a price below every piece. A BPE vocabulary has ranks for scores
(whole numbers): they are read as Zipf's law, log p = -ln(rank + 1) - ln(harmonic sum), which trains nothing; other
scores are taken as they are. Ids are those of the best path, not of BPE merges. Pieces that the model marks as hardly
usable (a score below -1e6: runs of spaces) follow the others in rank.

Defined results: null and empty texts have no ids; ties are broken as above; repeated rows get a row each; an empty
table gives no rows. Columns named by `keep` that clash with a result's are passed on with `_in` at the end of their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import by_texts, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_REMEMBERED = 120_000
_LONGEST_REMEMBERED = 64
_CHUNK = 256


#: Scores are rounded to this fraction, so that sums are exact.
_UNIT = 1 << 16
_NEVER = -(1 << 62)


def log_probabilities(scores: list[float], usable: list[bool]) -> list[float]:
    """The scores of pieces; ranks (whole numbers, descending) become log-probabilities by Zipf's law."""
    own = [s for s, u in zip(scores, usable, strict=True) if u and s > -1e6]
    ranks = len(own) > 2 and all(s == int(s) for s in own) and all(a >= b for a, b in zip(own[:-1], own[1:], strict=True))
    if not ranks:
        least = min(own, default=0.0)
        return [max(s, least - 5) for s in scores]
    order = sorted((i for i, u in enumerate(usable) if u), key=lambda i: (-scores[i], i))
    total = math.log(sum(1 / k for k in range(1, len(order) + 1)))
    out = [0.0] * len(scores)
    for k, i in enumerate(order, 1):
        out[i] = -math.log(k) - total
    return out


class Vocabulary:
    """Pieces with a space for U+2581, their scores (integers), and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int]) -> None:
        self.raw: list[bytes] = [b""] * len(pieces)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes = [-1] * 256
        byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        scores = log_probabilities(scores, [i not in special and not b for i, b in enumerate(byte)])
        for i, (p, s) in enumerate(zip(pieces, scores, strict=True)):
            if i in special:
                continue
            if byte[i]:
                self.bytes[int(byte[i][1], 16)] = i
                self.raw[i] = bytes([int(byte[i][1], 16)])
                continue
            plain, own = p.replace("▁", " "), round(s * _UNIT)
            self.raw[i] = plain.encode()
            if plain and (plain not in self.pieces or own > self.pieces[plain][1]):
                self.pieces[plain] = (i, own)
        # a tree of characters: a node is what its piece is (or None) and its children (or None)
        self.tree: dict[str, list] = {}
        for p, (i, s) in self.pieces.items():
            children, node = self.tree, None
            for c in p:
                if node is not None:
                    if node[1] is None:
                        node[1] = {}
                    children = node[1]
                node = children.setdefault(c, [None, None])
            node[0] = (s, (i,))
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_score = min((s for _, s in self.pieces.values()), default=0) - 10 * _UNIT
        # how long the pieces can be that begin with a character
        self.reach: dict[str, int] = {}
        for p in self.pieces:
            self.reach[p[0]] = max(self.reach.get(p[0], 0), len(p))
        inner = any(" " in p[1:] and p.strip(" ") for p in self.pieces)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.pieces))
        self.pattern = None if inner else rf" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else "")

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], special)


class StreamingViterbi:
    """Feeds characters in, gives committed ids out. `widest` is the longest trail there ever was, in characters."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text = ""  # characters from the last committed boundary on
        self.done = 0  # positions of `text` from which all pieces have been offered
        self.far = 0  # the last position that is reached
        self.score, self.start, self.own = [0], [0], [()]  # by position: the best sum, where its last piece starts, its ids
        self.widest = 0
        self.check_at = vocabulary.longest  # when paths are next searched for a common boundary

    def _advance(self, final: bool) -> list[int]:
        """Offers all pieces from the positions whose longest piece is in sight, committing where paths meet."""
        out: list[int] = []
        v, first, reach = self.v, self.v.tree.get, self.v.reach.get
        text, score, start, own, i, far = self.text, self.score, self.start, self.own, self.done, self.far
        n = len(text)
        while i < n:
            if not final and i + reach(text[i], 1) > n:
                break
            base = score[i]
            if base > _NEVER:
                node, j = first(text[i]), i + 1
                if node is None or node[0] is None:  # no piece for the character alone: its bytes
                    raw = text[i].encode("utf-8", "surrogatepass")
                    if (s := base + len(raw) * v.byte_score) >= score[j]:
                        score[j], start[j], own[j] = s, i, tuple([v.bytes[b] for b in raw])
                        if j > far:
                            far = j
                while node is not None:
                    hit, children = node
                    if hit is not None and (s := base + hit[0]) >= score[j]:
                        score[j], start[j], own[j] = s, i, hit[1]
                        if j > far:
                            far = j
                    if children is None or j >= n:
                        break
                    node = children.get(text[j])
                    j += 1
            i += 1
            if i >= self.check_at:
                self.done, self.far = i, far
                self.widest = max(self.widest, far)
                if b := i if far == i else self._meeting():
                    out += self._commit(b)
                    text, score, start, own, i, far = self.text, self.score, self.start, self.own, self.done, self.far
                    n = len(text)
                    self.check_at = i + v.longest
                else:  # paths that stay apart are looked at ever more rarely, so the work stays linear
                    self.check_at = 2 * i
        self.done, self.far = i, far
        return out

    def _meeting(self) -> int:
        """The last boundary on the paths of all open positions, 0 if they only share the first."""
        heads = {p for p in range(self.done, self.far + 1) if self.score[p] > _NEVER}
        while len(heads) > 1:
            latest = max(heads)
            heads.discard(latest)
            heads.add(self.start[latest])
        return heads.pop() if heads else 0

    def _commit(self, boundary: int) -> list[int]:
        ids: list[tuple[int, ...]] = []
        at = boundary
        while at:
            ids.append(self.own[at])
            at = self.start[at]
        base = self.score[boundary]
        self.text, self.done, self.far = self.text[boundary:], self.done - boundary, self.far - boundary
        self.score = [s - base if s > _NEVER else s for s in self.score[boundary:]]
        self.start = [0] + [s - boundary for s in self.start[boundary + 1 :]]
        self.own = [()] + self.own[boundary + 1 :]
        return [i for own in reversed(ids) for i in own]

    def feed(self, chunk: str) -> list[int]:
        self.text += chunk
        more = len(chunk)
        self.score += [_NEVER] * more
        self.start += [0] * more
        self.own += [()] * more
        return self._advance(False)

    def finish(self) -> list[int]:
        out = self._advance(True)
        return out + self._end()

    def _end(self) -> list[int]:
        """What is left when the text has ended; the stream is as new."""
        ids: list[int] = []
        at, start, own = len(self.text), self.start, self.own
        while at:
            piece = own[at]
            if len(piece) == 1:
                ids.append(piece[0])
            else:
                ids += piece[::-1]
            at = start[at]
        ids.reverse()
        self.text, self.done, self.far, self.score, self.start, self.own = "", 0, 0, [0], [0], [()]
        self.check_at = self.v.longest
        return ids

    def whole(self, text: str) -> list[int]:
        """The ids of a short text: fed and finished at once."""
        n = len(text)
        self.text, self.score, self.start, self.own = text, [0] + [_NEVER] * n, [0] * (n + 1), [()] * (n + 1)
        out = self._advance(True)
        return out + self._end() if out else self._end()


class Coder(dict):
    """Ids (as bytes of int32) by stretch of text; computed when missing. Two generations bound what is
    remembered: when the new one is full it becomes the old one, and the old one goes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.viterbi = StreamingViterbi(vocabulary)
        self.old: dict[str, bytes] = {}
        self.find = re.compile(vocabulary.pattern).findall if vocabulary.pattern else None

    def __missing__(self, stretch: str) -> bytes:
        out = self.old.get(stretch)
        if len(stretch) > _LONGEST_REMEMBERED:
            ids = array("i")
            for k in range(0, len(stretch), _CHUNK):
                ids.extend(self.viterbi.feed(stretch[k : k + _CHUNK]))
            ids.extend(self.viterbi.finish())
            return ids.tobytes()
        if out is None:
            out = array("i", self.viterbi.whole(stretch)).tobytes()
        if len(self) >= _REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[stretch] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.find is None:
            return self[" " + text]
        return b"".join(map(self.__getitem__, self.find(" " + text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text (without the space put in front)."""
        return b"".join(map(self.v.raw.__getitem__, ids.tolist()))[1:]


_coders: dict[tuple[str, int], Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """One coder for a worker process: what it remembers serves the next task too."""
    key = hashlib.md5(b"\0".join(vocabulary.raw)).hexdigest(), len(vocabulary.raw)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns with ids, their number, and whether decoding gives the text again."""

    def work():
        coder = _coder(vocabulary)

        def of(texts: tb.Texts, n: int) -> dict:
            made = [np.frombuffer(coder.encode(texts.text(i)), np.int32) for i in range(n)]
            counts = np.array([len(m) for m in made])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
            return {"n_ids": counts, "ids": ids, "round_trip": [coder.decode(m) == texts.raw(i) for i, m in enumerate(made)]}

        return of

    return by_texts(docs, keep, text, "n_ids bigint, ids array<int>, round_trip boolean", work)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str], ids: str = "ids") -> DataFrame:
    """The `keep` columns with the text of the ids (null for null ids); ids that are null or outside the vocabulary add nothing.
    A kept column called text comes out as text_in."""
    pieces = vocabulary.raw

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else b"".join(pieces[int(i)] for i in own if i is not None and 0 <= i < len(pieces))[1:].decode("utf-8", "replace") for own in values], dtype=object)

    return encoded.select(*[F.col(f"`{c}`").alias("text_in" if c == "text" else c) for c in keep], text(F.col(ids)).alias("text"))


def op9_sentencepieces(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Vocabulary.load(), ["doc_id"])
