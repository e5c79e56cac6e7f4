"""SentencePiece encoding and decoding by one pass of an Aho-Corasick automaton over the pieces.

The automaton reports, at every position, all pieces that end there (its output links). A pass from left to right keeps for
each position the best way to reach it:

* unigram models: the highest sum of scores (Viterbi);
* byte-pair models: scores of such a model are merge ranks and do not add up to the right cut, so the rule that relaxes a position differs: a
  piece may follow the last piece of the way so far if merging the two together gives just these two. A cut is the model's
  own exactly if this holds for all neighbours, so the first piece that fits, from the longest down, is right.

Characters that no piece covers become byte pieces, or the unknown piece in models without bytes. Words that a worker has met
are not cut again: pieces never reach over the start of a space run, so a text is cut there. Models that have such pieces are passed over whole texts.

Defined cases: null and empty texts have no pieces; a U+2581 in a text reads back as a space, as the format has it; unpaired surrogates cannot
occur in Spark strings; texts are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import ship
from .worker import BUDGET, Recent, blocks, held, spread

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_UNKNOWN_PENALTY = 10.0
MAX_FITS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces (text, score, kind) in id order, and what of the specification bears on cutting."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, trim: bool = False, byte_fallback: bool = True):
        self.pieces, self.kind, self.dummy_prefix, self.trim, self.byte_fallback = pieces, kind, dummy_prefix, trim, byte_fallback

    @classmethod
    def load(cls, path: str) -> "Model":
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, dummy, trim, fallback = [], UNIGRAM, True, True, False
        for field, value in _fields(data):
            if field == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        type_ = v
                pieces.append((piece, score, type_))
            elif field == 2:
                spec = dict(_fields(value))
                kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                dummy, trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        return cls(pieces, kind, dummy, trim, fallback)


class PieceCodec:
    """Encodes texts."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
        self.score = {p: model.pieces[i][1] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        if self.ids:
            self.automaton.make_automaton()
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.least = min(self.score.values(), default=0.0) - _UNKNOWN_PENALTY
        self.known = Recent(BUDGET)
        self.fits: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The cut of a short text by merging the best pair again and again."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > MAX_FITS:
                self.fits.clear()
            found = self.fits[a, b] = self._merged(a + b) == ([a, b] if a else [b])
        return found

    def _cut_pairs(self, unit: str) -> list[str]:
        n = len(unit)
        last: list[str | None] = [""] + [None] * n
        known, fit, ids = self.fits.get, self._fit, self.ids
        at = 0

        def closed(upto: int) -> int:
            for e in range(at, upto):  # a character without a piece stands for itself
                if last[e + 1] is None and last[e] is not None and unit[e] not in ids and fit(last[e], unit[e]):
                    last[e + 1] = unit[e]
            return upto

        for end, piece in self.automaton.iter(unit):  # of those that end here the longest comes first
            if end > at:
                at = closed(end)
            if last[end + 1] is None:
                before = last[end + 1 - len(piece)]
                if before is not None:
                    found = known((before, piece))
                    if found or found is None and fit(before, piece):
                        last[end + 1] = piece
        closed(n)
        return self._back(last, n)

    def _cut_scores(self, unit: str) -> list[str]:
        n = len(unit)
        best: list[float] = [0.0] + [float("-inf")] * n
        last: list[str | None] = [""] + [None] * n
        at = 0
        score, least = self.score, self.least

        def unknown(upto: int) -> int:
            for e in range(at, upto):  # a character without a piece of its own
                if unit[e] not in score and best[e] + least > best[e + 1]:
                    best[e + 1], last[e + 1] = best[e] + least, unit[e]
            return upto

        for end, piece in self.automaton.iter(unit):
            if end > at:
                at = unknown(end)
            start = end + 1 - len(piece)
            if unit[end] not in score and best[end] + least > best[end + 1]:
                best[end + 1], last[end + 1] = best[end] + least, unit[end]
            value = best[start] + score[piece]
            if value > best[end + 1]:
                best[end + 1], last[end + 1] = value, piece
        unknown(n)
        return self._back(last, n)

    @staticmethod
    def _back(last: list[str | None], n: int) -> list[str]:
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def cut(self, unit: str) -> list[str]:
        if not unit:
            return []
        if not self.ids:
            return list(unit)
        return (self._cut_pairs if self.model.kind == BPE else self._cut_scores)(unit)

    def _coded(self, unit: str) -> bytes:
        out: list[int] = []
        for piece in self.cut(unit):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.model.byte_fallback and self.byte:
                out += [self.byte[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def _prepared(self, text: str) -> str:
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, 4 bytes each."""
        text = self._prepared(text or "")
        if not self.splits or not self.model.byte_fallback:
            return self._coded(text)
        return b"".join(map(self._coded, _UNITS.findall(text)))

    def _ids(self, distinct: list[str]) -> list[bytes]:
        self.known.turn()
        return self.known.look_up(distinct, lambda new: list(map(self._coded, new)))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin and end. Null is empty."""
        texts = texts.fill_null("")
        if not self.splits or not self.model.byte_fallback or self.model.trim:
            odd = pa.array(np.ones(len(texts), bool))
        else:
            odd = pc.match_substring_regex(texts, f"^ |  |\0|{SPACE}")
        whole = {int(k): self.encode(texts[int(k)].as_py()) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        plain = pc.if_else(odd, "", texts)
        if self.model.dummy_prefix:
            plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        return spread(pc.split_pattern(pc.replace_substring(plain, " ", f"\0{SPACE}"), "\0"), whole, self._ids)


class Decoder:
    """decode(ids) gives the text."""

    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.values = [self._value(p, kind) for p, _, kind in model.pieces]

    @staticmethod
    def _value(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def decode(self, ids: bytes | np.ndarray) -> str:
        values = self.values
        data = b"".join([values[i] for i in memoryview(ids).cast("B").cast("I")]).decode("utf-8", "replace")
        return data[1:] if self.dummy_prefix and data.startswith(" ") else data


class _Both:
    """A worker's tables of one model file; what is not asked for is not built."""

    def __init__(self, path: str):
        self.model = Model.load(path)

    @functools.cached_property
    def codec(self) -> PieceCodec:
        return PieceCodec(self.model)

    @functools.cached_property
    def decoder(self) -> Decoder:
        return Decoder(self.model)


def _worker(path: str) -> _Both:
    return held(("pieces", path), lambda: _Both(path))


def encode_documents(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (4-byte words), n_pieces of every row; with decode also decoded, the text that the ids stand for, and same, whether it is the row's text."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(path)
        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                collects = gc.isenabled()
                gc.disable()
                ids, firsts = own.codec.encode_column(texts)
                ids = ids.astype("<u4")
                cuts = [ids[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                out = [batch.column(0).slice(lo, hi - lo), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array(np.diff(firsts), pa.int64())]
                if decode:
                    back = pa.array(list(map(own.decoder.decode, cuts)), pa.string())
                    out += [back, pc.equal(back, pc.replace_substring(texts.fill_null(""), SPACE, " "))]
                if collects:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "ids", "n_pieces"] + ["decoded", "same"] * decode
    out = "doc_id long, ids binary, n_pieces long" + ", decoded string, same boolean" * decode
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the text its ids stand for."""
    ship(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _worker(path).decoder.decode
        for batch in batches:
            texts = [decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
