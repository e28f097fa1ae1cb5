"""Exact Jaccard join of word n-gram sets by universe partition (operator 7).

Documents are sets of hashed word shingles.  Equal sets are one *node*.  For
each band of set sizes the universe of shingles is hashed into ``m`` segments.
Two sets that link differ in at most ``H`` shingles, so they agree on some
segment subset, or differ by one shingle on one of the ``u`` segments whose
one-deletion neighbourhoods are indexed too (pigeonhole).  ``m`` and ``u`` are
allocated per band by cost: signatures written against the points (1 for an
equal subset, 2 for a neighbourhood) that the pigeonhole needs.

Linked sets in fact agree on all the points that exceed ``H``, so pairs from
signatures with few nodes must share that many.  A signature of many nodes (a
*hot* one) is left out where the other signatures of its nodes have points
enough; a node that lacks points leaves out the most common signatures that it
can spare, and all nodes of its other ones count as candidates for each other.  Candidates form
groups; the sets of a group meet in one task and are joined exactly there.  A
group too heavy for a task is dealt to many: its members are compared with a
few centres in turn, and only what no centre linked is then compared with the
whole group, a block of it at a time.  What two centres linked, that nothing has
connected so far, is compared as far as it is near enough to both.  No link is
lost, no bucket is capped, and nothing is collected but totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, claim, digests, release_shuffles, shuffle_partitions, written
from .exactdedup import located, own_columns

WORDS, NUM, DEN = 5, 3, 4
#: The most nodes of a signature whose pairs are listed; beyond, it is hot.
HOT = 16
#: Signatures that a task should hold at once, pairs of nodes that it lists at once, and shingles of the sets that meet in one task.
TASK_SIGNATURES, SLICE_PAIRS, BLOCK_SHINGLES = 4_000_000, 500_000, 1_500_000
#: Bytes of uneven sets that go to all tasks at once; more go in further passes.
UNEVEN_BYTES = 16 << 20

#: The part of nodes whose segments fell so unevenly that they have no spare point.
UNEVEN = -1

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = x + np.uint64((salt * _ODD[0] + _ODD[1]) & (2**64 - 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes.

    Words are parted by the bytes 0x20 and 0x09-0x0D and A-Z are lower-cased:
    just what bytes.lower() and bytes.split() do.  A text with fewer words has
    the whole sequence as its one shingle, one without words the empty set.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    cached = hashes()
    h = np.fromiter(map(cached.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ out >> np.uint64(32)) * np.uint64(_ODD[k % 5]) + h[k : k + n]
    return np.unique(mixed(out))


def hashes() -> WordHashes:
    claim("ngramjoin", _HASHES.clear)
    return _HASHES


def node_of(s: np.ndarray) -> bytes:
    """The node of a set: a 128-bit digest of its shingles."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


class Scheme:
    """How sets that meet in one band of sizes are partitioned."""

    def __init__(self, band: int, low: int, high: int, num: int, den: int) -> None:
        self.band, self.low, self.high = band, low, high  # sizes of the smaller set
        self.largest = high * den // num
        self.m, self.u = self._allocate(num, den)

    @staticmethod
    def difference(n: int, largest: int, num: int, den: int) -> int:
        """The most shingles in which a set of ``n`` and a larger one can differ and link."""
        # common >= num/(num+den) * both sizes, so the difference is at most (den-num)/(den+num) of them
        return max((den - num) * (n + k) // (den + num) for k in range(n, min(largest, n * den // num) + 1)) if n < 64 else (den - num) * (n + min(largest, n * den // num)) // (den + num)

    def _allocate(self, num: int, den: int) -> tuple[int, int]:
        """The cheapest (segments, neighbourhood segments) with the points that are needed, and some to spare."""
        n = self.high
        best, choice = math.inf, (8 * n, 8 * n)
        need = self.difference(n, self.largest, num, den) + 1
        if need <= 2:  # one segment with its neighbourhood always has two points
            return 1, need - 1
        for m in sorted({math.ceil(need * f / 50) for f in (*range(35, 80), 100, 150, 200, 300)}):
            for u in sorted({0, m // 4, m // 2, 3 * m // 4, m}):
                lam = n / m
                none, one = (1 - 1 / m) ** n, n / m * (1 - 1 / m) ** (n - 1) if n else 0
                points = m * (1 - none) + u * (1 - none - one)
                # of the number of empty segments, which varies less than independent ones would
                spread = math.sqrt(max(0.25, m * none * (1 - (1 + lam) * none)) + u * (none + one) * (1 - none - one))
                if points - 5 * spread < need * 1.04:
                    continue
                signatures = m * (1 - none) + u * lam
                cost = signatures + 2 * m * one  # subsets of one shingle meet by chance most often
                if cost < best:
                    best, choice = cost, (m, u)
        return choice


class Plan:
    """Bands of set sizes; band k holds sizes over high(k-1) up to high(k)."""

    def __init__(self, num: int = NUM, den: int = DEN) -> None:
        self.num, self.den = num, den
        self.highs, self.schemes = [1], [Scheme(0, 1, 1, num, den)]

    def band(self, n: int) -> int:
        while self.highs[-1] < n:
            low = self.highs[-1] + 1
            high = max(low, low * self.den // self.num)
            self.schemes.append(Scheme(len(self.highs), low, high, self.num, self.den))
            self.highs.append(high)
        return int(np.searchsorted(self.highs, n))

    def of(self, n: int) -> list[Scheme]:
        """The schemes of a set: its own band's, and those of bands whose sets it can link with as the larger."""
        own = self.band(n)
        return [self.schemes[k] for k in range(own, -1, -1) if k == own or self.schemes[k].largest >= n]


def signatures(s: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set under a scheme, and the points that hang on each.

    A segment's subset is hashed by the sum of its mixed shingles; a
    one-deletion neighbour is that sum less one.  Empty subsets have none.
    """
    x = mixed(s, scheme.band + 1)
    segment = ((x >> np.uint64(32)) * np.uint64(scheme.m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, y = segment[order], mixed(s, scheme.band + 100_003)[order]
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums, counts, at = np.add.reduceat(y, first), np.diff(np.append(first, len(y))), segment[first]
    label = (np.uint64(scheme.band) << np.uint64(40)) + at.astype(np.uint64)
    whole = mixed(sums ^ mixed(label, 3), 5)
    near = at < scheme.u
    points = 1 + (near & (counts >= 2))
    if not scheme.u:
        return whole, points
    wide = np.repeat(near & (counts >= 2), counts)
    less = mixed(np.repeat(sums, counts)[wide] - y[wide] ^ mixed(np.repeat(label, counts)[wide], 3), 5)
    return np.concatenate([whole, less]), np.concatenate([points, np.full(len(less), 2)])


class Emitter:
    """Turns sets into rows (part, blob) of signatures, a chunk of sets at a time."""

    CHUNK = 400_000

    def __init__(self, parts: int, num: int, den: int) -> None:
        self.plan, self.parts = Plan(num, den), parts
        self._clear()

    def _clear(self) -> None:
        self.keys, self.codes, self.sizes, self.heads, self.uneven, self.held = [], [], [], [], [], 0

    def add(self, s: np.ndarray, node: bytes) -> Iterator[tuple[int, bytes]]:
        plan, n = self.plan, len(s)
        found = []
        for k, scheme in enumerate(plan.of(n)):
            keys, points = signatures(s, scheme)
            if not k:  # its own band: what hangs on each signature, and what all of them exceed the need by
                spare = self.total(s, scheme) - Scheme.difference(n, n * plan.den // plan.num, plan.num, plan.den)
                found.append((keys, points))
            else:
                found.append((keys, np.zeros(len(keys), np.int64)))
        self.keys += [k for k, _ in found]
        self.codes += [c for _, c in found]
        if spare < 1:
            self.uneven.append(node)
        size = sum(len(k) for k, _ in found)
        self.sizes.append(size)
        self.heads.append(node + np.array([n, spare], "<i4").tobytes())
        self.held += size
        if self.held >= self.CHUNK:
            yield from self.flush()

    @staticmethod
    def total(s: np.ndarray, scheme: Scheme) -> int:
        """The points of a set under a scheme: each segment's once."""
        x = mixed(s, scheme.band + 1)
        counts = np.bincount(((x >> np.uint64(32)) * np.uint64(scheme.m) >> np.uint64(32)).astype(np.int64), minlength=scheme.m)
        return int((counts > 0).sum() + (counts[: scheme.u] >= 2).sum())

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.heads:
            return
        if self.uneven:
            yield UNEVEN, b"".join(self.uneven)
        keys, codes = np.concatenate(self.keys), np.concatenate(self.codes).astype(np.uint8)
        owner = np.repeat(np.arange(len(self.heads)), self.sizes)
        part = (keys >> np.uint64(40)).astype(np.int64) % self.parts
        order = np.lexsort((owner, part))
        keys, codes, owner, part = keys[order], codes[order], owner[order], part[order]
        heads = np.frombuffer(b"".join(self.heads), "V24")
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for p in range(self.parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                mine, counts = np.unique(owner[a:b], return_counts=True)
                k = keys[a:b]
                low, high = k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)
                yield p, b"".join([np.array([len(mine), b - a], "<u4").tobytes(), heads[mine].tobytes(), counts.astype("<u4").tobytes(), low.tobytes(), high.tobytes(), codes[a:b].tobytes()])
        self._clear()


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


class Meeting:
    """The signatures of one part, gathered from the tasks that wrote them.

    A signature takes 13 bytes.  Those that turn out hot are handed out as
    rows while blobs still come in and are held no longer, so that a part
    with a signature of any number of nodes takes no more memory than others.
    """

    def __init__(self, hot: int = HOT, most: int = TASK_SIGNATURES) -> None:
        self.hot, self.most, self.limit = hot, most, most
        self.heads = np.empty((0, 3), np.uint64)  # node (two words), size and spare
        self.key, self.owner, self.code = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.hot_keys = np.empty(0, np.uint64)
        self.new: list[tuple] = []
        self.n_new = 0

    def add(self, blob: bytes) -> Iterator[Rows]:
        """Take in a blob of ``Emitter``; yields (heads, keys, codes) of hot signatures."""
        d, n = np.frombuffer(blob, "<u4", 2).tolist()
        at = 8 + 24 * d
        heads = np.frombuffer(blob, "<u8", 3 * d, 8).reshape(d, 3)
        counts = np.frombuffer(blob, "<u4", d, at)
        low = np.frombuffer(blob, "<u4", n, at := at + 4 * d)
        high = np.frombuffer(blob, "<u2", n, at := at + 4 * n)
        code = np.frombuffer(blob, np.uint8, n, at + 2 * n)
        self.new.append((heads, counts, low, high, code))
        self.n_new += n
        if len(self.key) + self.n_new >= self.limit:
            yield from self.settle()
            self.limit = max(self.most, 2 * len(self.key))

    def settle(self) -> Iterator[Rows]:
        """Sort what came in to what is held and let go of what is hot."""
        if not self.new:
            return
        first, keys, owners = len(self.heads), [self.key], [self.owner]
        for heads, counts, low, high, _ in self.new:
            keys.append((high.astype(np.uint64) << np.uint64(32)) + low)
            owners.append(np.repeat(np.arange(first, first + len(heads), dtype=np.int32), counts))
            first += len(heads)
        key, owner, code = np.concatenate(keys), np.concatenate(owners), np.concatenate([self.code, *(x[4] for x in self.new)])
        heads = np.concatenate([self.heads, *(x[0] for x in self.new)])
        self.new, self.n_new = [], 0
        # a node that several tasks met is one
        order = np.lexsort((heads[:, 1], heads[:, 0]))
        heads = heads[order]
        other = np.concatenate([[True], (heads[1:, :2] != heads[:-1, :2]).any(1)])
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(other) - 1
        heads, owner = heads[other], place[owner]
        # a quarter of the signatures is sorted at a time
        quarter, sorted_parts, hot_keys = (key >> np.uint64(46)).astype(np.uint8), [], [self.hot_keys]
        for q in range(4):
            mine = np.flatnonzero(quarter == q)
            mine = mine[np.lexsort((owner[mine], key[mine]))]
            k, o, c = key[mine], owner[mine], code[mine]
            own = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])[: len(k)]
            k, o, c = k[own], o[own], c[own]
            # hot by now, or already before
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
            size, names = np.diff(np.append(first, len(k))), k[first]
            many = size > self.hot
            if len(self.hot_keys) and len(names):
                many |= self.hot_keys[np.minimum(np.searchsorted(self.hot_keys, names), len(self.hot_keys) - 1)] == names
            if many.any():
                hot_keys.append(names[many])
                gone = np.repeat(many, size)
                yield heads[o[gone]], k[gone], c[gone]
                k, o, c = k[~gone], o[~gone], c[~gone]
            sorted_parts.append((k, o, c))
        del key, owner, code, quarter, place
        self.hot_keys = np.unique(np.concatenate(hot_keys))
        self.key, owner, self.code = (np.concatenate([part[n] for part in sorted_parts]) for n in range(3))
        used = np.unique(owner)
        self.heads, self.owner = heads[used], np.searchsorted(used, owner).astype(np.int32)

    def pairs(self, most: int = SLICE_PAIRS) -> Iterator[Rows]:
        """(heads of the smaller sets, heads of the larger, points) of nodes that share signatures, after ``settle``.

        A pair comes once for each slice of signatures in which it shares some.
        """
        first = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self.key) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(self.key)))
        first, size = first[size > 1], size[size > 1]
        ends = np.cumsum(size * (size - 1) // 2)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield from self._slice(first[at:to], size[at:to])
            at = to

    def _slice(self, first: np.ndarray, size: np.ndarray) -> Iterator[Rows]:
        packed, points = [], []
        for n in np.unique(size).tolist():
            runs = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    worth = np.maximum(self.code[runs + i], self.code[runs + j])
                    packed.append((self.owner[runs + i].astype(np.int64)[worth > 0] << 32) + self.owner[runs + j][worth > 0])
                    points.append(worth[worth > 0])
        packed, which = np.unique(np.concatenate(packed), return_inverse=True)
        if len(packed):
            points = np.bincount(which, np.concatenate(points), len(packed)).astype(np.int64)
            a, b = self.heads[packed >> 32], self.heads[packed & 0xFFFFFFFF]
            n_a, n_b = a[:, 2].astype(np.uint32), b[:, 2].astype(np.uint32)
            swap = (n_a > n_b) | (n_a == n_b) & ((a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
            yield np.where(swap[:, None], b, a), np.where(swap[:, None], a, b), points


def _spares(heads: np.ndarray) -> np.ndarray:
    return (heads[:, 2] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _nodes(heads: np.ndarray) -> pa.Array:
    return digests(np.ascontiguousarray(heads[:, :2]).tobytes())


def join_sets(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """All linked pairs of a group, exactly, by an inverted index over its shingles."""
    lengths = np.array([len(s) for s in sets])
    token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = []
    for k, s in enumerate(sets):
        low, high = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(den * common >= num * (lengths + lengths[k] - common)).tolist():
            if j > k and lengths[k]:
                out.append((k, j))
    return out


def _roots(n: int, links) -> list[int]:
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def connected(sets: list[np.ndarray], num: int = NUM, den: int = DEN, centres: int = 8) -> list[int]:
    """The root of each set's component under the links of a group, exactly.

    A few sets are compared with all others first; in a group of near copies
    that already joins most.  Then each set outside the largest component is
    compared with all; links within that component would change nothing.
    """
    if not sets:
        return []
    lengths = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]

    def links(k: int) -> np.ndarray:
        s = sets[k]
        low = np.searchsorted(token, s, "left")
        counts = np.searchsorted(token, s, "right") - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero(den * common >= num * (lengths + lengths[k] - common))

    roots = np.arange(len(sets))

    def merge(k: int) -> None:
        same = np.unique(roots[links(k)])
        if len(same) > 1:
            roots[np.isin(roots, same)] = same[0]

    done = set()
    for _ in range(min(centres, len(sets))):
        alone = [k for k in np.flatnonzero(np.bincount(roots, minlength=len(sets))[roots] == 1).tolist() if k not in done]
        if not alone:
            break
        done.add(alone[0])
        merge(alone[0])
    largest = int(np.bincount(roots).argmax())
    for k in np.flatnonzero(roots != largest).tolist():
        if k not in done:
            merge(k)
    return roots.tolist()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of an edge table (a, b), root being its component's smallest node.

    Alternating star contraction: neighbours are linked to the smallest one
    around them until nothing changes.  Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder.  The least neighbours
    are written too: joins between two shuffles are such that Spark splits
    where a node has very many neighbours.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v")
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and node of each row, and file and row if ``docs`` has them; node is null for an empty set."""
    names = ["doc_id", "n_shingles", "node", *docs.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), *b.columns[2:]], names)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary" + (", file string, row bigint" if docs.columns[2:] else ""))


def _signature_rows(docs: DataFrame, parts: int, words: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitter, seen = Emitter(parts, num, den), set()
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "blob"])
        for b in batches_of(batches):
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                if len(s) and (node := node_of(s)) not in seen:  # copies are written once a task
                    seen.add(node)
                    if rows := list(emitter.add(s, node)):
                        yield batch(rows)
        if rows := list(emitter.flush()):
            yield batch(rows)

    return docs.select("text").mapInArrow(run, "part int, blob binary")


def _candidates(blobs: DataFrame, parts: int, hot: int) -> DataFrame:
    """Rows of kind 0 (pairs a, b with points and the spare of a), 1 (node a of a hot signature) and 2 (uneven node a).

    A hot row or a pair may come several times; points of pairs add up.
    """
    names = ["kind", "a", "b", "key", "points", "spare"]

    def batches_out(kind: int, a: pa.Array, b=None, key=None, points=None, spare=None) -> Iterator[pa.RecordBatch]:
        n = len(a)
        types = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
        rest = [pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((b, key, points, spare), types, strict=True)]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), a, *rest], names)
        for k in range(0, n, 20_000):
            yield whole.slice(k, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met = None, Meeting(hot)

        def hot_rows(found: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
            for heads, keys, codes in found:
                yield from batches_out(1, _nodes(heads), key=((np.uint64(now) << np.uint64(48)) + keys).view(np.int64), points=codes.astype(np.int32), spare=_spares(heads))

        def out() -> Iterator[pa.RecordBatch]:
            yield from hot_rows(met.settle())
            for a, b, points in met.pairs():
                yield from batches_out(0, _nodes(a), _nodes(b), points=points.astype(np.int32), spare=_spares(a))

        for b in batches:  # sorted by part: one part's signatures are held at a time
            for p, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p == UNEVEN:
                    yield from batches_out(2, digests(blob.as_py()))
                    continue
                if p != now and now is not None:
                    yield from out()
                    met = Meeting(hot)
                now = p
                yield from hot_rows(met.add(blob.as_py()))
        if now is not None:
            yield from out()

    return blobs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "kind int, a binary, b binary, key bigint, points int, spare int")


def _group_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges that connect just what links, from rows (group, node, blob) sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []

        def out() -> pa.RecordBatch:
            roots = connected(held, num, den)
            edges = [(nodes[k], nodes[r]) for k, r in enumerate(roots) if k != r]
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["a", "b"])

        for b in batches:
            for group, node, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != now and nodes:
                    yield out()
                    nodes, held = [], []
                now = group
                if node not in nodes[-1:]:
                    nodes.append(node)
                    held.append(np.frombuffer(blob, np.uint64))
        if nodes:
            yield out()

    parts = shuffle_partitions(sets.sparkSession)
    return sets.select("group", "node", "blob").repartition(parts, "group").sortWithinPartitions("group", "node").mapInArrow(run, "a binary, b binary")


class Held:
    """Sets that others are compared with, by an inverted index over their shingles."""

    def __init__(self, nodes: list[bytes], sets: list[np.ndarray], num: int, den: int) -> None:
        self.nodes, self.num, self.den = nodes, num, den
        self.lengths = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.lengths)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        """How many shingles each held set has in common with ``s``."""
        low = np.searchsorted(self.token, s, "left")
        counts = np.searchsorted(self.token, s, "right") - low
        if not counts.any():
            return np.zeros(len(self.nodes), np.int64)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(self.owner[at], minlength=len(self.nodes))

    def linked(self, s: np.ndarray, common: np.ndarray | None = None) -> list[int]:
        """The places of the held sets that link with ``s``."""
        common = self.common(s) if common is None else common
        return np.flatnonzero((common > 0) & (self.den * common >= self.num * (self.lengths + len(s) - common))).tolist()

    def reached(self, s: np.ndarray, common: np.ndarray) -> list[int]:
        """The places of the held sets that some set may link with that links with ``s``.

        One less the similarity is a metric, so those are at most two links' distances away.
        """
        return np.flatnonzero(self.den * common >= (2 * self.num - self.den) * (self.lengths + len(s) - common)).tolist()


#: Kinds of rows: a streamed set and the first held one that it links with, held sets that link with the same one, a streamed set and a held one that it reaches.
LINK, SAME, REACH = 0, 1, 2


def _against_held(rows: DataFrame, num: int, den: int, reach: bool = False, first: bool = False) -> DataFrame:
    """Rows (a, b, kind) from rows (group, part, streamed, node, blob).

    In each part of a group the rows that aren't streamed are held, those that
    are go past them one by one; each gets an edge to one held set that it
    links with, and held sets that link with the same one get edges among
    each other.  With ``reach`` each also gets a row for the held sets that it
    reaches, but for those that it is connected with in this part.  With
    ``first`` the first edge of a part is enough: its held sets are connected
    already, and so are its streamed ones.
    """
    schema = "a binary, b binary, kind int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, held, roots, done = None, [], [], None, [], False
        for b in batches:
            found = []
            for group, part, streamed, node, blob in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                if (group, part) != now:
                    now, nodes, sets, held, done = (group, part), [], [], None, False
                if done:
                    continue
                s = np.frombuffer(blob.as_py(), np.uint64)
                if not streamed:
                    if node in nodes[-1:]:
                        continue
                    nodes.append(node)
                    sets.append(s)
                    continue
                if held is None:
                    held, roots, sets = Held(nodes, sets, num, den), list(range(len(nodes))), []
                common = held.common(s)
                near = held.linked(s, common)
                if near:
                    found.append((node, nodes[near[0]], LINK))
                    done = first
                    for k in near[1:]:
                        if roots[k] != roots[near[0]]:
                            found.append((nodes[k], nodes[near[0]], SAME))
                            roots = [roots[near[0]] if r == roots[k] else r for r in roots]
                if reach:
                    found += [(node, nodes[k], REACH) for k in held.reached(s, common) if not near or roots[k] != roots[near[0]]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["a", "b", "kind"])

    keys = ["group", "part"]
    dealt = rows.select(*keys, "streamed", "node", "blob").repartition(shuffle_partitions(rows.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys, "streamed", "node").mapInArrow(run, schema)


def _heavy_links(sets: DataFrame, num: int, den: int, block: int, centres: int = 32) -> DataFrame:
    """Edges that connect just what links in groups too heavy for a task, from rows (group, node, n_shingles, weight, blob).

    A round takes some centres among the nodes that no centre has linked
    yet and compares the whole group with them, in as many tasks as it has
    blocks.  Rounds end when what is left of any group is two blocks at most, or
    when they no longer link a tenth of it; that is then compared with the whole group, blocks against
    blocks.  Nodes that centres have linked are compared by ``_between_stars``
    where their centres aren't connected.
    """
    blocks = F.ceil(F.col("weight") / block).cast("int")
    dealt = sets.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    streamed = dealt.select("group", F.col("part").cast("string").alias("part"), F.lit(True).alias("streamed"), "node", "blob")
    left, edges, stars, reached = sets.select("group", "node", "n_shingles"), None, None, None
    more = lambda known, new: new if known is None else known.union(new)

    def size_of(left: DataFrame) -> tuple[int, int]:
        """(nodes left, shingles left of the group that has most)."""
        row = left.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).agg(F.sum("n"), F.max("w")).first()
        return row[0] or 0, row[1] or 0

    count, most = size_of(left)
    while count and (edges is None or most > 2 * block):
        some = left.groupBy("group", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(centres))).agg(F.min("node").alias("node")).select("group", "node")
        held = dealt.join(written(some, "ngram-centres").hint("merge"), ["group", "node"], "left_semi")
        held = held.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<string>")).alias("part"), F.lit(False).alias("streamed"), "node", "blob")
        found = written(_against_held(held.union(streamed), num, den, reach=True), "ngram-links")
        edges = more(edges, found.where(F.col("kind") != REACH).select("a", "b"))
        reached = more(reached, found.where(F.col("kind") == REACH).select(F.col("a").alias("node"), F.col("b").alias("other")))
        star = found.where(F.col("kind") == LINK).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("centre"))
        star = written(left.join(star.hint("merge"), "node").select("node", "n_shingles", "centre").distinct(), "ngram-stars")
        stars = more(stars, star)
        left = written(left.join(star.select("node").hint("merge"), "node", "left_anti").select("group", "node", "n_shingles"), "ngram-left")
        before = count
        count, most = size_of(left)
        if count > 0.9 * before:
            break
    if count:
        rest = dealt.join(left.select("group", "node").hint("merge"), ["group", "node"], "left_semi")
        weights = written(rest.groupBy("group").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("rest_blocks")), "ngram-left")
        mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("rest_blocks")).cast("int")
        held = rest.join(weights.hint("merge"), "group").select("group", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: _place(mine, k))).alias("part"), F.lit(False).alias("streamed"), "node", "blob")
        others = dealt.join(weights.hint("merge"), "group").select("group", F.explode(F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda k: _place(k, F.col("part")))).alias("part"), F.lit(True).alias("streamed"), "node", "blob")
        edges = more(edges, written(_against_held(held.union(others), num, den), "ngram-links").select("a", "b"))
    if edges is None:
        return sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    between = _between_stars(sets, stars, reached, edges, num, den, block)
    return edges if between is None else edges.union(between)


def _place(i, j):
    return F.format_string("%d:%d", i, j)


def _between_stars(sets: DataFrame, stars: DataFrame, reached: DataFrame, edges: DataFrame, num: int, den: int, block: int) -> DataFrame | None:
    """Edges (a, b) between the stars (node, n_shingles, centre) of centres that ``edges`` don't connect.

    If two nodes of two stars link, each reaches the other's centre.  So the nodes of
    either star that reach the other's centre meet, blocks against blocks, until
    one link is found; a star is connected by itself.
    """
    roots = components(edges, "ngram-roots")
    ends = stars.select("centre").distinct().join(roots.hint("merge"), F.col("centre") == F.col("node"), "left")
    ends = written(ends.select("centre", F.coalesce("root", "centre").alias("root")), "ngram-stars")
    theirs = reached.join(stars.hint("merge"), "node").join(ends, "centre")
    others = ends.select(F.col("centre").alias("other"), F.col("root").alias("other_root"))
    theirs = theirs.join(others, "other").where("root <> other_root")
    low, high = F.least("centre", "other"), F.greatest("centre", "other")
    theirs = written(theirs.select(F.concat(low, high).alias("group"), (F.col("centre") == low).alias("streamed"), "node", "n_shingles").distinct(), "ngram-stars")
    side = lambda streamed, name: F.ceil(F.sum(F.when(F.col("streamed") == streamed, F.col("n_shingles"))) / block).cast("int").alias(name)
    weights = theirs.groupBy("group").agg(side(False, "held_blocks"), side(True, "blocks")).where("held_blocks is not null and blocks is not null")
    weights = written(weights, "ngram-stars")
    if weights.isEmpty():
        return None
    each = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    parts = F.when(F.col("streamed"), each("held_blocks", lambda k: _place(k, mine("blocks")))).otherwise(each("blocks", lambda k: _place(mine("held_blocks"), k)))
    meeting = theirs.join(weights, "group").select("group", F.explode(parts).alias("part"), "streamed", "node")
    meeting = meeting.join(sets.select("node", "blob").hint("merge"), "node").select("group", "part", "streamed", "node", "blob")
    return written(_against_held(meeting, num, den, first=True), "ngram-links").select("a", "b")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4 << 20):
            sets = [shingles(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "blob"])

    return docs.select("text").mapInArrow(run, "node binary, blob binary").where("node is not null")


def _member_sets(texts: DataFrame, words: int) -> DataFrame:
    """(group, node, n_shingles, weight, blob) of texts whose node is known; rows that merely share the id of such a text go."""
    names = ["group", "node", "n_shingles", "weight", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4 << 20):
            out = [(group, node, len(s), weight, s.tobytes()) for t, node, group, weight in zip(b.column(0), *(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True) if len(s := shingles(t.as_py(), words)) and node_of(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names)

    return texts.select("text", "node", "group", "weight").mapInArrow(run, "group binary, node binary, n_shingles bigint, weight bigint, blob binary")


def _short_of_points(docs: DataFrame, rows: DataFrame, uneven: DataFrame, words: int, num: int, den: int, most_bytes: int = UNEVEN_BYTES) -> DataFrame | None:
    """Edges of the few nodes whose segments fell so unevenly that they have no spare point: each against all rows.

    Their sets go to all tasks, at most ``most_bytes`` at a time; a pass over
    the texts looks each text's shingles up in all of them at once.
    """
    if uneven.isEmpty():
        return None
    spark = docs.sparkSession
    queries = written(rows.join(uneven, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "ngram-uneven")
    texts = docs.join(queries.select(F.col("doc_id").alias("q_id")), F.col("doc_id").eqNullSafe(F.col("q_id")), "left_semi")
    chosen = _sets(texts, words).join(queries.select("node"), "node", "left_semi").dropDuplicates(["node"])
    edges, chunk, size = None, [], 0

    def against(chunk: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held([node for node, _ in shared.value], [np.frombuffer(blob, np.uint64) for _, blob in shared.value], num, den)
            for b in batches_of(batches):
                found = []
                for t in b.column(0):
                    s = shingles(t.as_py(), words)
                    if len(s) and (near := held.linked(s)):
                        node = node_of(s)
                        found += [(node, held.nodes[k]) for k in near if held.nodes[k] != node]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])

        return written(docs.select("text").mapInArrow(run, "a binary, b binary"), "ngram-links")

    for r in chosen.toLocalIterator():
        chunk.append((bytes(r.node), bytes(r.blob)))
        size += len(r.blob) + 16
        if size >= most_bytes:
            part, chunk, size = against(chunk), [], 0
            edges = part if edges is None else edges.union(part)
    if chunk:
        edges = against(chunk) if edges is None else edges.union(against(chunk))
    return edges


def _hot_stars(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, lost) points of nodes on hot signatures, and edges (a, b) of the hot signatures that can't be left out."""
    hots = found.where("kind = 1").groupBy("key", F.col("a").alias("node")).agg(F.max("points").alias("points"), F.first("spare").alias("spare"))
    hots = written(hots, "ngram-hot")
    lost = written(hots.groupBy("node").agg(F.sum("points").alias("lost"), F.first("spare").alias("spare")), "ngram-hot")
    short = lost.where("lost > 0 and spare - lost < 1").select("node")
    # such a node leaves out its most common signatures, as long as their points are fewer than it has to spare
    sizes = written(hots.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("centre")), "ngram-hot")
    theirs = hots.where("points > 0").join(short.hint("merge"), "node", "left_semi").join(sizes.hint("merge"), "key")
    common_first = Window.partitionBy("node").orderBy(F.col("nodes").desc(), "key")
    wanted = theirs.withColumn("left_out", F.sum("points").over(common_first)).where("left_out >= spare").select("key", "centre").distinct()
    stars = hots.join(written(wanted, "ngram-hot").hint("merge"), "key").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    return lost.select(F.col("node").alias("a"), "lost"), stars


def _grouped(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, hot: int = HOT, block: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text, and file and row or not) with their nodes, and (node, root) of every node that links."""
    spark = docs.sparkSession
    rows = written(_rows(docs, words), "ngram-rows")
    docs = docs.select("doc_id", "text")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    # about 0.8 signatures a shingle; few parts, as each set's head is written once a part
    parts = max(math.ceil(0.8 * total / TASK_SIGNATURES), min(24, shuffle_partitions(spark), math.ceil(total / 1_000_000)), 1)
    found = written(_candidates(_signature_rows(docs, parts, words, num, den), parts, hot), "ngram-candidates")
    release_shuffles(spark)

    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("points").alias("points"), F.first("spare").alias("spare"))
    if found.where("kind = 1").isEmpty():
        candidates = pairs.where("points >= spare").select("a", "b")
    else:
        lost, stars = _hot_stars(found)
        candidates = pairs.join(lost.hint("merge"), "a", "left").where("points >= spare - coalesce(lost, 0)").select("a", "b").union(stars)
    groups = written(components(candidates, "ngram-groups").withColumnRenamed("root", "group"), "ngram-groups")

    # the sets of a group meet in one task, unless they are too heavy for it
    members = rows.where("node is not null").join(groups.hint("merge"), "node").groupBy("node", "group").agg(F.min("doc_id").alias("g_id"), F.first("n_shingles").alias("n"))
    members = written(members, "ngram-members")
    weights = written(members.groupBy("group").agg(F.sum("n").alias("weight")), "ngram-members")
    members = members.join(weights.hint("merge"), "group").select("node", "group", "g_id", "weight")
    texts = docs.join(members, F.col("doc_id").eqNullSafe(F.col("g_id"))).select("text", "node", "group", "weight")
    sets = _member_sets(texts, words)
    heavy = F.col("weight") > block
    if weights.where(heavy).isEmpty():
        links = written(_group_links(sets, num, den), "ngram-links")
    else:
        sets = written(sets, "ngram-sets")
        links = written(_group_links(sets.where(~heavy), num, den), "ngram-links").union(_heavy_links(sets.where(heavy), num, den, block))
    release_shuffles(spark)
    uneven = found.where("kind = 2").select(F.col("a").alias("node")).distinct()
    extra = _short_of_points(docs, rows, uneven, words, num, den)
    if extra is not None:
        links = links.union(extra)
    return rows, components(links, "ngram-roots")


def _named(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of each row of ``docs``.

    Rows link when their sets' intersection is at least ``num / den`` of their
    union.  ``component_id`` is the smallest doc_id reachable by links,
    ``class_id`` the smallest with the very same set.  Null and empty texts
    have the empty set, link with nothing and are components of their own.
    Rows that share an id are sets of their own; a null id counts for nothing
    in a component unless it has no other.  An empty table gives no row.
    Parameters: ``words`` a shingle, ``num`` and ``den``, ``hot`` (nodes beyond
    which a signature's pairs aren't listed), ``block`` (shingles of the sets
    that meet in one task); the last two change the plan and not the result.
    """
    rows, roots = _grouped(_named(docs, id_col, text_col), **parameters)

    # from nodes back to rows
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ngram-classes")
    least = written(classes.groupBy("root").agg(F.min("class_id").alias("component_id")), "ngram-classes")
    known = classes.join(least.hint("merge"), "root").select("node", "class_id", "component_id")
    some = rows.where("node is not null").join(known.hint("merge"), "node").select("doc_id", "n_shingles", "component_id", "class_id")
    return some.union(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which exactly one of each component stays.

    Rows with the very same set are of one component.  The row with the
    smallest id stays, nulls last, then the first by file and row; rows with an
    empty set all stay.  The filter is by content locator, so it also holds for
    repeated and null ids.
    """
    placed = located(docs)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows, roots = _grouped(_named(placed, id_col, text_col, file.alias("file"), row.alias("row")), **parameters)
    members = rows.where("node is not null").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "file", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first")
    # roots of one row drop out before the join
    stays = members.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"))
    stays = written(stays, "ngram-stays")
    gone = members.join(stays.hint("merge"), "root").where("not (file = keep_file and row = keep_row)").select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row"))
    placed = placed.select(*own_columns(docs), file.alias("__at_file"), row.alias("__at_row"))
    left = placed.join(gone, (F.col("__at_file") == F.col("__gone_file")) & (F.col("__at_row") == F.col("__gone_row")), "left_anti")
    return left.drop("__at_file", "__at_row")
