"""Benchmark decontamination by CGK embedding (operator 3).

A document is contaminated by a benchmark item of L words if some window of L
consecutive words of it (or all of it, if it has fewer) is within
``int(rate * L)`` word edits of the item.  The CGK random walk maps a word
sequence to one of 3 L words such that edit distance becomes Hamming distance;
bit-sampling LSH compares a few random places of the embedding, and is repeated
with new walks as often as the target recall asks for; candidates are verified
by exact edit distance.

Windows that can't qualify are left out before they are embedded: an edit
changes two word pairs of a window at most, so a window needs
``L - 1 - 2 * edits`` pairs that occur in the item.  That test loses nothing.
Pairs that very many items share are left out of those items that can spare
them, each lowering the number that the item's windows need by its own places.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, claim, written

#: Allowed edits per item word; items shorter than MIN_WORDS never match.
RATE, MIN_WORDS = 0.25, 5
RECALL, SAMPLES = 0.98, 3
#: Items that may share a word pair before it is left out of those that can spare it.
COMMON_PAIR = 64
#: A block of benchmark text that is sent to all executors at once; more go in further passes.
BLOCK_BYTES = 16 << 20

_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class Hashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def edit_distance(a, b, most: int) -> int:
    """Word edits between two sequences, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, diagonal, row[0] = i, row[0], i
        low = row[0]
        for j in range(1, len(b) + 1):
            up = row[j]
            left = min(diagonal + (x != b[j - 1]), up + 1, left + 1)
            diagonal, row[j] = up, left
            low = min(low, left)
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edits between each row of ``a`` and the same row of ``b``."""
    places = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.repeat(places[None], len(a), 0)
    for i in range(a.shape[1]):
        new = row + 1  # a word of a without partner
        np.minimum(new[:, 1:], row[:, :-1] + (a[:, i, None] != b), out=new[:, 1:])
        # words of b without partner: the least so far, plus one for each step on
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row[:, -1]


class Walks:
    """The repeated CGK walks and places sampled for sequences of one length."""

    def __init__(self, length: int, repeats: int, samples: int = SAMPLES, seed: int = 5) -> None:
        draw = lambda kind, most, *shape: np.random.default_rng([seed, length, kind]).integers(0, most, (repeats, *shape), dtype=np.uint64).T
        self.length, self.repeats = length, repeats
        steps, two, one = 3 * length, np.uint64(2), np.uint64(1)
        # the first walks are the same however many there are
        self.odd = np.ascontiguousarray(draw(0, 2**63, steps)) * two + one
        self.places = draw(1, steps, samples).astype(np.int64)
        self.factors = draw(2, 2**63, samples) * two + one
        self.salt = np.arange(1, repeats + 1, dtype=np.uint64) * _MIX

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys, (repeats, windows), of word hashes, (windows, length); 0 pads."""
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
        at = np.zeros((self.repeats, len(windows)), np.int64)
        rows = np.arange(len(windows))[None, :]
        key = np.repeat(self.salt[:, None], len(windows), 1)
        for step in range(int(self.places.max()) + 1):
            out = padded[rows, at]
            taken = (self.places == step)[:, :, None] * self.factors[:, :, None]
            if taken.any():
                key = key + (out[None] * taken).sum(0, dtype=np.uint64)
            # the walk moves on where the random bit of this step and word is 1
            at = np.minimum(at + (out * self.odd[step][:, None] >> np.uint64(63)).astype(np.int64), self.length)
        return key ^ key >> np.uint64(29)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A sequence with so many random edits, as a window of the same length; what follows it is random."""
    seq = words.tolist()
    for _ in range(edits):
        kind, p = rng.integers(3), rng.integers(max(1, len(seq)))
        if kind == 0:
            seq[p] = int(rng.integers(1, 2**62))
        elif kind == 1:
            seq.insert(p, int(rng.integers(1, 2**62)))
        elif len(seq) > 1:
            del seq[p]
    return np.array((seq + rng.integers(1, 2**62, len(words)).tolist())[: len(words)], np.uint64)


@cache
def repeats_for(length: int, edits: int, recall: float = RECALL, samples: int = SAMPLES, trials: int = 500) -> int:
    """The least repeats with which the very walks that will be used find ``recall`` of sequences with all the edits they may have.

    By simulation, in which half of the misses that ``recall`` allows may occur.
    """
    if not edits:
        return 1
    rng = np.random.default_rng([17, length, edits])
    plain = rng.integers(1, 2**62, (trials, length), dtype=np.uint64)
    changed = np.stack([edited(p, edits, rng) for p in plain])
    walks = 32
    while True:
        tried = Walks(length, walks, samples)
        found = np.logical_or.accumulate(tried.keys(plain) == tried.keys(changed)).mean(1)
        enough = np.flatnonzero(1 - found <= (1 - recall) / 2)
        if len(enough):
            return int(enough[0]) + 1
        walks *= 2


class Index:
    """Items of a benchmark block by length, with their LSH keys."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, min_words: int = MIN_WORDS, repeats: dict[int, int] | None = None) -> None:
        """``repeats`` of each length, if worked out before."""
        self.hashes, self.rate = Hashes(), rate
        by_length: dict[int, list] = {}
        for item_id, text in items:
            words = self.hashes.of(words_of(text))
            if len(words) >= min_words:
                by_length.setdefault(len(words), []).append((item_id, words))
        self.groups, self.bags, self.group_of, self.ids = [], [], [], []
        lengths, pairs, owners, often = [], [], [], []
        for length, group in sorted(by_length.items()):
            walks = Walks(length, (repeats or {}).get(length) or repeats_for(length, int(rate * length)))
            keys = walks.keys(np.stack([w for _, w in group])).ravel()
            order = np.argsort(keys, kind="stable")
            self.groups.append((length, int(rate * length), group, walks, keys[order], np.tile(np.arange(len(group)), walks.repeats)[order]))
            for _, words in group:
                own, places = np.unique(self._pairs(words), return_counts=True)
                pairs.append(own)
                often.append(places)
                owners.append(np.full(len(own), len(lengths)))
                lengths.append(length)
                self.bags.append(np.unique(words, return_counts=True))
                self.group_of.append(len(self.groups) - 1)
            self.ids += [i for i, _ in group]
        self.lengths = np.array(lengths, np.int64)
        self.edits = (rate * self.lengths).astype(np.int64)
        self.needs = self.lengths - 1 - 2 * self.edits
        pair, owner, often = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((pairs, np.uint64), (owners, np.int64), (often, np.int64)))
        kept, self.spared = self._without_common(pair, owner, often)
        self.needs = self.needs - self.spared
        pair, owner = pair[kept], owner[kept]
        # items by pair: item numbers of pair k stand from offsets[k] to offsets[k + 1]
        order = np.argsort(pair, kind="stable")
        self.pairs, first = np.unique(pair[order], return_index=True)
        self.offsets, self.owners = np.append(first, len(pair)), owner[order]

    def _without_common(self, pair: np.ndarray, owner: np.ndarray, often: np.ndarray, common: int = COMMON_PAIR) -> tuple[np.ndarray, np.ndarray]:
        """Which (pair, item) rows stay, and the places that each item's left-out pairs had.

        Of an item's pairs that more than ``common`` items have, the commonest
        go, as long as half of the pairs that its windows need are left.
        """
        kept, spared = np.ones(len(pair), bool), np.zeros(len(self.lengths), np.int64)
        _, which, items = np.unique(pair, return_inverse=True, return_counts=True)
        items = items[which] if len(pair) else items
        for row in sorted(np.flatnonzero(items > common).tolist(), key=lambda r: (-items[r], r)):
            k = owner[row]
            if spared[k] + often[row] <= self.needs[k] // 2:
                kept[row], spared[k] = False, spared[k] + often[row]
        return kept, spared

    @staticmethod
    def _pairs(words: np.ndarray) -> np.ndarray:
        return words[:-1] * _MIX ^ words[1:]

    def matches(self, text: str | None) -> list:
        """Ids of the items that contaminate a text, in order, without repeats."""
        if not self.groups or not text:
            return []
        words = self.hashes.of(words_of(text))
        if len(words) < 2:
            return []
        n, pairs = len(words), self._pairs(words)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        places = np.flatnonzero(self.pairs[at] == pairs)
        if not len(places):
            return []
        # a row for each place of the text and item that has its pair, by item
        low, counts = self.offsets[at[places]], self.offsets[at[places] + 1] - self.offsets[at[places]]
        item = self.owners[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        place = np.repeat(places, counts)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        # places from which enough of an item's pairs stand within a window of its size
        last = np.arange(len(item)) + self.needs[item] - 1
        inside = last < len(item)
        last = np.where(inside, last, 0)
        dense = np.flatnonzero(inside & (item[last] == item) & (place[last] - place <= self.lengths[item] - 2) & (self.lengths[item] <= n))
        by_item: dict[int, set] = {}
        for j in dense.tolist():
            length = int(self.lengths[item[j]])
            by_item.setdefault(int(item[j]), set()).update(range(max(0, int(place[last[j]]) - length + 2), min(int(place[j]), n - length) + 1))
        found: set = set()
        for k, starts in by_item.items():
            # of a window's words all but the edits are words of the item, each as often as there at most
            length, at = int(self.lengths[k]), np.array(sorted(starts), np.int64)
            own = np.concatenate([self._shared_words(words, at[a : a + 2048], k) for a in range(0, len(at), 2048)])
            good = own >= length - int(self.edits[k])
            if not good.any():
                continue
            # the fullest windows first: one is enough for an item
            order = np.argsort(-own[good], kind="stable")
            found |= self._search(words, at[good][order], words, k, found)
        # texts that are shorter than an item are one window
        held = np.bincount(item, minlength=len(self.lengths))
        for k in np.flatnonzero((self.lengths > n) & (self.lengths - self.edits <= n) & (held >= n - 1 - 2 * self.edits - self.spared)).tolist():
            padded = np.concatenate([words, np.zeros(int(self.lengths[k]) - n, np.uint64)])
            found |= self._search(words, np.zeros(1, np.int64), padded, k, found)
        return sorted(found, key=lambda i: (i is None, i))

    def _shared_words(self, words, starts, k: int) -> np.ndarray:
        """The size of the multiset intersection of each window with item ``k``."""
        kinds, often = self.bags[k]
        length, n = int(self.lengths[k]), len(kinds)
        part = words[starts[0] : starts[-1] + length]
        place = np.minimum(np.searchsorted(kinds, part), n - 1)
        place = np.where(kinds[place] == part, place, n)
        windows = place[(starts - starts[0])[:, None] + np.arange(length)] + np.arange(len(starts))[:, None] * (n + 1)
        held = np.bincount(windows.ravel(), minlength=len(starts) * (n + 1)).reshape(len(starts), n + 1)
        return np.minimum(held[:, :n], often).sum(1)

    def _search(self, words, starts, padded, k: int, found: set) -> set:
        """Items of item ``k``'s length that windows match, until item ``k`` is among them."""
        length, edits, group, walks, keys, owners = self.groups[self.group_of[k]]
        item_id, out, at, size = self.ids[k], set(found), 0, 8
        while at < len(starts) and item_id not in out:
            part = starts[at : at + size]
            out |= self._verified(words, part, padded[part[:, None] + np.arange(length)], length, edits, group, walks, keys, owners)
            at, size = at + size, 256
        return out

    @staticmethod
    def _verified(words, starts, windows, length, edits, group, walks, keys, owners) -> set:
        got = walks.keys(windows)
        low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
        r, w = np.nonzero(high > low)
        if not len(r):
            return set()
        counts = high[r, w] - low[r, w]
        owner = owners[np.repeat(low[r, w] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        pair = np.unique(np.repeat(w, counts) * len(group) + owner)
        w, owner = pair // len(group), pair % len(group)
        stack = np.stack([g[1] for g in group])
        out: set = set()
        for a in range(0, len(w), 2048):
            near = edit_distances(windows[w[a : a + 2048], : min(length, len(words))], stack[owner[a : a + 2048]]) <= edits
            out |= {group[k][0] for k in np.unique(owner[a : a + 2048][near]).tolist()}
        return out


def _blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    block, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text) + 16
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _passes(rows: DataFrame, benchmark: DataFrame, rate: float, block_bytes: int, step) -> DataFrame:
    """``rows`` after a map for each block of the benchmark; between two blocks they are written.

    So one block is on the driver, in broadcasts and in workers at a time.
    """
    shared = None
    for block in _blocks(benchmark, block_bytes):
        if shared is not None:
            rows = written(rows, "decontam")
            shared.destroy()
        # simulated once, here, rather than in each worker
        repeats = {n: repeats_for(n, int(rate * n)) for n in {len(words_of(text)) for _, text in block} if n >= MIN_WORDS}
        shared = benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, rate, repeats))
        rows = rows.mapInArrow(step(shared), rows.schema)
    return rows


_INDEXES: dict[str, Index] = {}


def index_of(key: str, block: list, rate: float, repeats: dict[int, int]) -> Index:
    """One index per worker process: that of the block at work."""
    claim("decontam", _INDEXES.clear)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(block, rate, repeats=repeats)
    return _INDEXES[key]


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items and sorted item_ids for each row of ``docs``.

    Null and empty texts match nothing, as do null or empty items and those of
    under MIN_WORDS words.  Items that share an id count once; a null item id
    comes last.  Repeated rows give repeated results.  A map without a shuffle;
    a benchmark beyond ``block_bytes`` takes a further map for each block.
    """
    schema = "doc_id bigint, text string, item_ids array<bigint>"
    fields = arrow_schema(schema)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<bigint>").alias("item_ids"))

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(*shared.value)
            for b in batches_of(batches):
                ids = [[*old, *(i for i in index.matches(t.as_py()) if i not in old)] for old, t in zip(b.column(2).to_pylist(), b.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, fields.field(2).type)], schema=fields)

        return run

    rows = _passes(rows, benchmark, rate, block_bytes, step)
    n = F.size("item_ids").cast("bigint")
    return rows.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.array_sort("item_ids").alias("item_ids"))


def filter_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    place = docs.columns.index(text_col)

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(*shared.value)
            for b in batches_of(batches):
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(place)], pa.bool_()))

        return run

    return _passes(docs, benchmark, rate, block_bytes, step)
