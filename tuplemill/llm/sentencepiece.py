"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over all pieces reads a normalised text once.  At
each position its output links give every piece that ends there; each relaxes
the best segmentation that ends at that position, so one pass is a Viterbi
search.  What a piece adds to the score of the way before it follows from the model file:

* unigram models: the piece's own score, whatever came before;
* BPE models: the piece's score if it and the piece before it stay apart when
  the merge rules run on the two alone, else minus infinity.  Without that
  transition score the largest sum isn't what the merges give; with it the
  best way is, and the ids equal those of the merge procedure.

Since no piece has a space mark after another character, and none a line feed,
segments between such places are encoded once each and kept in a bounded cache.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, claim, record_batch

SPACE = "▁"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean, ids array<int>"
# Fixed values of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNKNOWN_PENALTY = 10.0


class Model:
    """A SentencePiece model file: pieces, automaton, segment cache."""

    KEEP = 400_000

    def __init__(self, data: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with prefixed space marks are supported")
        self.kind, self.prefix = proto.trainer_spec.model_type, SPACE if spec.add_dummy_prefix else ""
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if any(t in (USER_DEFINED, UNUSED) for _, _, t in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.unknown = next((k for k, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        bytes_of = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)] if bytes_of else None
        self.score = [s for _, s, _ in self.pieces]
        self.unknown_score = min((self.score[k] for k in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.surface = [self._surface(p, t) for p, _, t in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.automaton.add_word(p, (k, len(p)))
        if self.ids:
            self.automaton.make_automaton()
        # runs of unknown characters are one piece where there are no byte pieces, so they may cross segments
        self._whole = self.byte_ids is None or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self._bridged = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._gains: dict[tuple[int, int], float] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode())

    # -- encoding

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def segments(self, norm: str) -> list[str]:
        """Parts of a normalised text that pieces never reach across."""
        if SPACE * 2 in norm:
            return re.findall(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", norm)
        return norm.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self._whole:
            return [np.array(self.viterbi(self.normalise(t)), np.uint32) for t in texts]
        parts = [self.segments(self.normalise(t)) for t in texts]
        if len(self._new) > self.KEEP:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        for part in set().union(*parts) - new.keys():
            ids = old.get(part)
            new[part] = b"".join(map(self._cached, self._cut(part))) if ids is None else ids
        return [np.frombuffer(b"".join(map(new.__getitem__, ps)), np.uint32) for ps in parts]

    def _cut(self, part: str) -> list[str]:
        """A segment, cut between characters that stand side by side in no piece."""
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self._bridged]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)] if cuts else [part]

    def _cached(self, part: str) -> bytes:
        ids = self._new.get(part)
        if ids is None:
            ids = self._old.get(part)
            if ids is None:
                ids = np.array(self.viterbi(part), np.uint32).tobytes()
            self._new[part] = ids
        return ids

    def viterbi(self, part: str) -> list[int]:
        """The ids of a segment: one pass of the automaton, relaxing as it goes."""
        n = len(part)
        if not n:
            return []
        known = self.ids
        ends: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # (length, id) of the last piece of the best way to a position
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        strange = [k for k, c in enumerate(part) if c not in known]
        hits = self.automaton.iter(part) if known else iter(())
        if strange:
            hits = self._with_unknown(hits, strange)
        gains = self._gains
        for last, (k, size) in hits:
            start = last + 1 - size
            if best[start] == -math.inf:
                continue
            step = (ends[start][1], k)
            gain = gains.get(step)
            if gain is None:
                gain = gains[step] = self._gain(*step)
            if best[start] + gain > best[last + 1]:
                best[last + 1], ends[last + 1] = best[start] + gain, (size, k)
        if len(gains) > 2_000_000:
            gains.clear()
        out, at = [], n
        while at:
            size, k = ends[at]
            if k >= 0:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(part[at - 1].encode())]
            elif not (out and at < n and ends[at + 1][1] < 0):  # a run of unknown characters is one unknown piece
                out.append(self.unknown)
            at -= size
        return out[::-1]

    @staticmethod
    def _with_unknown(hits: Iterator, strange: list[int]) -> Iterator:
        """Hits, with one for each character that is no piece, in order of their ends."""
        at = 0
        for hit in hits:
            while at < len(strange) and strange[at] <= hit[0]:
                yield strange[at], (-1, 1)
                at += 1
            yield hit
        for k in strange[at:]:
            yield k, (-1, 1)

    def merge(self, text: str) -> list[str]:
        """The plain merge procedure: the pair with the best score, leftmost first."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            found, where = None, -1
            for k in range(len(parts) - 1):
                joined = ids.get(parts[k] + parts[k + 1])
                if joined is not None and (found is None or score[joined] > found):
                    found, where = score[joined], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _gain(self, before: int, piece: int) -> float:
        """What piece number ``piece`` adds to the score of a way that ends with ``before``; -1 is the start, or an unknown character."""
        if piece < 0:
            return self.unknown_score
        if self.kind == BPE and not self._apart(self.pieces[before][0] if before >= 0 else "", self.pieces[piece][0]):
            return -math.inf
        return self.score[piece]

    def _apart(self, before: str, piece: str) -> bool:
        """Whether two pieces, each made of its own merges, stay side by side."""
        return self.merge(before + piece) == ([before, piece] if before else [piece])

    # -- decoding

    def decode(self, ids) -> str:
        surface = self.surface
        text = b"".join([surface[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_MODELS: dict[int, Model] = {}


def model(data: bytes) -> Model:
    """One model per worker process and file."""
    claim("sentencepiece", _MODELS.clear)
    key = zlib.crc32(data)
    if key not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


def load(path: str) -> bytes:
    """A model file's bytes; read on the driver and sent along with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode the whole text of every row.

    Returns doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), round_trip (whether the ids decode to the very text) and
    ids.  Null and empty texts have no ids and round-trip to the empty text.
    A text that holds the mark U+2581 itself decodes to a space there.
    Repeated rows give repeated results; a null id stays null.
    """
    data, fields = load(path), arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data)
        for b in batches_of(batches, 2 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for doc_id, text, ids in zip(b.column(0).to_pylist(), texts, m.encode_all(texts), strict=True):
                rows.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), m.decode(ids.tolist()) == text, ids.astype(np.int32)))
            yield record_batch(rows, fields)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
