"""Token ids in fixed-width bit-packed files (operator 8).

A shard file holds the ids of consecutive documents, each id in as many bits as
the vocabulary needs::

    magic "TMBP", u16 version, u16 bits, u32 block, u64 documents, u64 ids,
    i64 partition, i64 number of the shard in its partition,
    i64 doc_id and u8 null flag of each document,
    u64 first id of each document (and the end),
    u64 byte offset of each block (and the end),
    the blocks: ``block`` ids each, packed little-endian, each from a byte,
    magic "PBMT"

Block offsets allow random access to any id; within a block ids are unpacked
by vectorised numpy shifts.  Shards are written by Spark's own file committer
(one row is one file), so a lost executor or a repeated task leaves no part
files behind and any file system that Spark can write will do.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, claim, shuffle_partitions, work_path, written

MAGIC, END = b"TMBP", "PBMT"
HEAD = "<4sHHIQQqq"
HEAD_SIZE = struct.calcsize(HEAD)
BLOCK = 4096
#: Widths that are whole numbers of the machine.
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}
_STRIP = ".,!*#$%&|"
#: A character that parts pieces which the library encodes in one text, its byte-level token, and how many pieces are joined.
MARK, MARK_TOKEN, JOINED = "\x1f", chr(0x100 + 0x1F), 200
#: Pieces whose ids are put in order at once.
GATHERED = 1 << 19
#: First bytes, in UTF-8, of characters from U+0300 on; before, none is a mark.
_FROM_0300 = re.compile(rb"[\xcc-\xf4]")


@cache
def _marks() -> re.Pattern:
    """Characters that may compose with a letter before them, or whose decomposition starts with one that may."""
    import sys
    import unicodedata

    found = []
    for c in range(0x300, sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "M" or unicodedata.combining(unicodedata.normalize("NFD", ch)[0]):
            found.append(c)
    runs, start = [], found[0]
    for a, b in zip(found, [*found[1:], -1], strict=True):
        if b != a + 1:
            runs.append(f"{chr(start)}-{chr(a)}")
            start = b
    return re.compile("[" + "".join(runs) + "]")


def bits_for(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack unsigned ids into ``bits`` bits each, least significant first."""
    if not len(ids):
        return b""
    if bits in WHOLE:  # the same bytes as below
        return ids.astype(WHOLE[bits]).tobytes()
    ids = ids.astype(np.uint64)
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros((len(ids) * bits + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(ids << shift, first)
    over = np.flatnonzero(shift + np.uint64(bits) > 64)  # one id at most runs over into each next word
    out[word[over] + 1] |= ids[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block, as uint32."""
    if not n:
        return np.empty(0, np.uint32)
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], n).astype(np.uint32)
    words = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def encode_shard(doc_ids: list, counts: list[int], ids: np.ndarray, bits: int, partition: int = 0, number: int = 0, block: int = BLOCK) -> bytes:
    """A shard file but for its end mark."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([
        struct.pack(HEAD, MAGIC, 1, bits, block, len(doc_ids), len(ids), partition, number),
        known.tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.r_[0, np.cumsum(counts, dtype=np.uint64)].astype("<u8").tobytes(),
        np.r_[0, np.cumsum([len(b) for b in blocks], dtype=np.uint64)].astype("<u8").tobytes(),
        *blocks,
    ])


class Shard:
    """Reads a shard file; ``ids(a, b)`` touches only the blocks it needs."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, self.block, self.n_docs, self.n_ids, self.partition, self.number = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1 or data[-len(END) :] != END.encode():
            raise ValueError("not a complete bit-packed shard")
        at, n = HEAD_SIZE, self.n_docs
        known = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(known, null, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at := at + 9 * n).astype(np.int64)
        count = -(-self.n_ids // self.block)
        self._blocks = np.frombuffer(data, "<u8", count + 1, at := at + 8 * (n + 1)).astype(np.int64) + at + 8 * (count + 1)
        self._data = data

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self._data[self._blocks[k] : self._blocks[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.starts[k], self.starts[k + 1])


# Fixed values of vocabulary files whose texts may be parted at blanks.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _parts_at_blanks(spec: dict) -> bool:
    """Whether a vocabulary file's settings are such that no id depends on characters across a blank."""
    steps = (spec.get("normalizer") or {}).get("normalizers")
    first, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    words = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
    level = len(rest) == 1 and {k: rest[0].get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
    marks = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    model = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("fuse_unk")
    return bool(steps == NORMALIZERS and words and level and marks and model and not spec.get("truncation") and not spec.get("padding"))


class LetterEncoder:
    """Encodes words of letters before U+0250 with a file whose texts may be parted at blanks.

    The normaliser just lowers such words and the word pattern leaves them whole,
    so the library gets them lowered, with the file's model and byte level and
    blanks to part at, which costs it less.  A word's last token is known by the model's suffix.
    """

    def __init__(self, spec: dict) -> None:
        from tokenizers import Tokenizer

        blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}
        self._library = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": blanks, "post_processor": None, "added_tokens": []}))
        vocabulary, suffix = self._library.get_vocab(), spec["model"]["end_of_word_suffix"]
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def serves(spec: dict) -> bool:
        """Whether every word's last token, and no other, ends in the model's suffix."""
        from tokenizers.pre_tokenizers import ByteLevel

        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        plain = not (model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"))
        return bool(suffix and not suffix.isalpha() and plain and all(c in model["vocab"] and c + suffix in model["vocab"] for c in ByteLevel.alphabet()))

    @staticmethod
    def takes(word: str) -> bool:
        return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word))

    def encode(self, words: list[str]) -> Iterator[bytes]:
        for e in self._library.encode_batch_fast([" ".join(words[k : k + JOINED]).lower() for k in range(0, len(words), JOINED)], add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self._last[ids]) + 4).tolist()
            yield from map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))


class WordEncoder:
    """Encodes whole texts with a tokenizers file, a blank-separated piece at a time.

    With the settings below, normaliser and pre-tokeniser never join characters
    across a space or line feed, so the ids of a text are those of its pieces
    in turn; files with other settings get their texts whole.  A piece is further parted
    into a stem that ends in a Latin letter or digit and a tail of ASCII marks,
    which the pre-tokeniser parts as well; stems of letters alone go by
    ``LetterEncoder``.  Pieces seen before come from a cache of bounded size.
    """

    KEEP = 440_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.vocabulary = self._library.get_vocab_size()
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        spec = json.loads(self._library.to_str())
        self._whole = not _parts_at_blanks(spec)
        self._letters = LetterEncoder(spec) if not self._whole and LetterEncoder.serves(spec) else None
        mark = self._library.encode(MARK, add_special_tokens=False).ids
        #: The one id of the mark, if it has one that holds its byte: no part without the mark has that id.
        self._mark = mark[0] if len(mark) == 1 and MARK_TOKEN in self._library.id_to_token(mark[0]) else None

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what no cache has goes to the library in one call.

        Only the distinct pieces of the texts become Python objects.
        """
        if self._whole:
            return [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]
        pieces = pc.split_pattern(pa.array([self._lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        which, offsets = coded.indices.to_numpy(), pieces.offsets.to_numpy()
        known = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        del pieces, coded
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        source, starts = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(sizes[which])])
        ids = np.empty(before[-1], np.uint32)
        for k in range(0, len(which), GATHERED):
            some, at = which[k : k + GATHERED], before[k : k + GATHERED + 1]
            ids[at[0] : at[-1]] = source[np.repeat(starts[some] - at[:-1], sizes[some]) + np.arange(at[0], at[-1])]
        cuts = before[offsets].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces."""
        if len(self._new) > self.KEEP:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        found = list(map(new.get, pieces))
        at, whole, parted = [], [], []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            piece = pieces[k]
            if (ids := old.get(piece)) is not None:
                new[piece] = found[k] = ids
            elif piece[-1:] in _STRIP and len(parts := self._parts(piece)) > 1:
                parted.append((k, parts))
            else:
                at.append(k)
                whole.append(piece)
        for k, piece, ids in zip(at, whole, self._encoded(whole), strict=True):
            new[piece] = found[k] = ids
        wanted = set()
        for p in {p for _, parts in parted for p in parts}:
            if p not in new:
                if (ids := old.get(p)) is not None:
                    new[p] = ids
                else:
                    wanted.add(p)
        wanted = list(wanted)
        new.update(zip(wanted, self._encoded(wanted), strict=True))
        for k, parts in parted:
            new[pieces[k]] = found[k] = b"".join([new[p] for p in parts])
        return found

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, by the library."""
        if self._letters is None:
            return self._marked(parts)
        taken = list(map(LetterEncoder.takes, parts))
        words = self._letters.encode(list(compress(parts, taken)))
        rest = iter(self._marked([p for p, t in zip(parts, taken, strict=True) if not t]))
        return [next(words) if t else next(rest) for t in taken]

    def _marked(self, parts: list[str]) -> list[bytes]:
        """The ids of each part: many parts in one text, with a mark between blanks after each but the last."""
        if self._mark is None:
            return [np.array(e.ids, np.uint32).tobytes() for e in self._library.encode_batch_fast(parts, add_special_tokens=False)]
        plain = [p for p in parts if MARK not in p and "<|" not in p]
        rest = [p for p in parts if MARK in p or "<|" in p]
        joined = [f" {MARK} ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        known = {}
        for k, e in enumerate(self._library.encode_batch_fast(joined + rest, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            data = ids.tobytes()
            if k >= len(joined):
                known[rest[k - len(joined)]] = data
                continue
            at = (4 * np.flatnonzero(ids == self._mark)).tolist()
            known |= zip(plain[k * JOINED : (k + 1) * JOINED], map(data.__getitem__, map(slice, [0, *(a + 4 for a in at)], [*at, len(data)])), strict=True)
        return [known[p] for p in parts]

    @staticmethod
    def _lowered(text: str) -> str:
        """A text with ASCII in lower case where that changes no id, for fewer pieces.

        The normaliser lowers too, but composes before it does: a letter that a
        mark may follow must stay as it is.  Special tokens are found before
        both, so texts that may hold one stay as they are.
        """
        if "<|" in text:
            return text
        if text.isascii():
            return text.lower()
        data = text.encode()
        return text if _FROM_0300.search(data) and _marks().search(text) else data.lower().decode()

    @staticmethod
    def _parts(piece: str) -> tuple[str, ...]:
        """Strings whose ids, in turn, are those of the piece."""
        stem = piece.rstrip(_STRIP)
        if stem and stem != piece and stem[-1].isalnum() and stem[-1] < "ɐ" and stem[-1] != "İ":
            return (stem, piece[len(stem) :])
        return (piece,)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    claim("bitpack", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 2_000_000) -> None:
    """Encode every document and write shard files in ascending id order.

    Texts are range-partitioned by ``doc_id`` (nulls first, ties by a hash of the
    text and the text, so that an id of very many rows is split too), then
    encoded and packed where they land: one shuffle, of texts, and none of ids.
    A shard is closed once it has ``shard_ids`` ids, so a task holds one shard
    and one document.  Null texts count as empty; each document ends in
    ``end_id``.  An empty table writes no shard.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        partition, number = TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, held = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            data = encode_shard(doc_ids, counts, np.concatenate(parts) if parts else np.empty(0, np.uint32), bits, partition, number)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for b in batches_of(batches, 8 << 20):
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all([t or "" for t in b.column(1).to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                counts.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= shard_ids:
                    yield close()
                    doc_ids, counts, parts, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(max(1, shuffle_partitions(spark)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt.drop("tie").mapInArrow(shards, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", END).text(path)


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read shard files back: one row per document, from the unpacked ids.

    Columns: partition, number (of the shard in it), place (of the document in
    its shard), doc_id, local_start, n_tokens, ids_crc32, and ``ids``
    (array of int) if asked for.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                shard = Shard(data.as_py())
                for a in range(0, shard.n_docs, 500):
                    ks = range(a, min(a + 500, shard.n_docs))
                    got = [shard.document(k) for k in ks]
                    columns = {
                        "partition": pa.array([shard.partition] * len(got), pa.int64()),
                        "number": pa.array([shard.number] * len(got), pa.int64()),
                        "place": pa.array(list(ks), pa.int64()),
                        "doc_id": pa.array(shard.doc_ids[a : a + 500], pa.int64()),
                        "local_start": pa.array(shard.starts[a : a + len(got)], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in got], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "partition bigint, number bigint, place bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    return _shard_files(spark, path).mapInArrow(rows, schema + (", ids array<int>" if with_ids else ""))


def shard_starts(rows: DataFrame) -> DataFrame:
    """The number of ids before each shard, from the rows of ``read_ids``.

    The only global order is over one row per partition.
    """
    shards = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("shard_ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("partition").agg(F.sum("shard_ids").alias("part_ids"))
    parts = parts.select("partition", F.coalesce(F.sum("part_ids").over(before(Window.orderBy("partition"))), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("shard_ids").over(before(Window.partitionBy("partition").orderBy("number"))), F.lit(0))
    return shards.withColumn("inside", inside).join(parts, "partition").select("partition", "number", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 2_000_000, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to files, read the files back, and digest them.

    Returns doc_id, start (ids of all documents before it in ascending id
    order), n_tokens (with the end id) and ids_crc32, all from the files.
    Repeated ids follow each other in the order of their texts' hashes, then
    texts; null ids come first; empty and null texts have the end id alone.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id, shard_ids)
    rows = written(read_ids(spark, path, with_ids=False), "token-rows")  # the shards are read once
    return rows.join(shard_starts(rows), ["partition", "number"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
