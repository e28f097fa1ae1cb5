"""Language identification with hyperdimensional profiles (operator 1).

Every letter has a random vector of +1 and -1.  An n-gram's vector binds
(multiplies) the vectors of its letters, each permuted (rolled) by its place; a
text's vector bundles (adds) those of its n-grams; a language's prototype
bundles the texts that are labelled with it.  A text gets the language whose
prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, claim, record_batch

UNDETERMINED = "und"
#: A text has a language if its cosine is beyond so many standard deviations of that of random vectors.
CHANCE = 2.0
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, cosine double"


class Space:
    """Vectors of letters, n-grams and texts.

    Letter vectors follow from the code point and the seed alone, so all tasks
    agree on them.  Vectors of n-grams seen before are kept, up to ``most``.
    """

    def __init__(self, dims: int = 1024, n: int = 3, seed: int = 7, most: int = 24_000) -> None:
        self.dims, self.n, self.seed, self.most = dims, n, seed, most
        self._letters: dict[int, np.ndarray] = {}
        self._keys = np.empty(0, np.uint64)
        self._rows = np.empty(0, np.int64)
        self._vectors = np.empty((0, dims), np.float32)
        self._used = 0
        self._alpha = np.zeros(0x110000, bool)
        self._alpha[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8)
            self._letters[code] = bits * 2 - 1
        return self._letters[code]

    def bind(self, key: int) -> np.ndarray:
        """The vector of an n-gram: its letters, each rolled by its place."""
        out = np.ones(self.dims, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return out

    def ngrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The distinct n-grams of the lower-cased words with their counts, or None if there is no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        codes = np.where(self._alpha[codes], codes, 32)
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) < self.n:
            return None
        keys = sum((codes[k : len(codes) - self.n + 1 + k] << np.uint64(21 * (self.n - 1 - k)) for k in range(self.n)), np.uint64(0))
        return np.unique(keys, return_counts=True)

    def bundle(self, text: str) -> np.ndarray | None:
        """The vector of a text, or None if it has no letter."""
        found = self.ngrams(text)
        if found is None:
            return None
        out = np.zeros(self.dims)
        step = min(4096, self.most)
        for a in range(0, len(found[0]), step):
            out += self._sum(found[0][a : a + step], found[1][a : a + step])
        return out

    def _sum(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == keys[inside]
        if not known.all():
            new = keys[~known]
            if self._used + len(new) > self.most:
                self._keys, self._rows, self._used, new = np.empty(0, np.uint64), np.empty(0, np.int64), 0, keys
            if self._used + len(new) > len(self._vectors):
                grown = np.empty((min(self.most, max(2048, 2 * (self._used + len(new)))), self.dims), np.float32)
                grown[: self._used] = self._vectors[: self._used]
                self._vectors = grown
            for k, key in enumerate(new.tolist()):
                self._vectors[self._used + k] = self.bind(key)
            merged = np.concatenate([self._keys, new])
            rows = np.concatenate([self._rows, np.arange(self._used, self._used + len(new))])
            order = np.argsort(merged)
            self._keys, self._rows, self._used = merged[order], rows[order], self._used + len(new)
            at = np.searchsorted(self._keys, keys)
        return counts.astype(np.float32) @ self._vectors[self._rows[at]]


_SPACES: dict[tuple, Space] = {}


def space(dims: int, n: int, seed: int) -> Space:
    """One space per worker process and set of parameters."""
    claim("langid", _SPACES.clear)
    key = (dims, n, seed)
    if key not in _SPACES:
        _SPACES[key] = Space(dims, n, seed)
    return _SPACES[key]


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id, as text, leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


class Profiles:
    """Language prototypes, and what they say about a text."""

    def __init__(self, langs: list[str], sums: np.ndarray, dims: int, n: int, seed: int) -> None:
        self.langs, self.dims, self.n, self.seed = langs, dims, n, seed
        norms = np.linalg.norm(sums, axis=1, keepdims=True) if len(langs) else np.ones((0, 1))
        self.prototypes = sums / np.where(norms > 0, norms, 1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, cosine); the score is the softmax of the cosines, times 20."""
        vector = space(self.dims, self.n, self.seed).bundle(text) if text and self.langs else None
        if vector is None:
            return UNDETERMINED, 0.0, 0.0
        cosines = self.prototypes @ vector / (np.linalg.norm(vector) or 1.0)
        best = int(np.argmax(cosines))
        return self.langs[best], float(1 / np.exp((cosines - cosines[best]) * 20).sum()), float(cosines[best])


    def identified(self, text: str | None, bound: float) -> bool:
        """Whether the cosine with some prototype is ``bound`` at least; without prototypes, whether there is a letter."""
        if not text:
            return False
        if not self.langs:
            return space(self.dims, self.n, self.seed).ngrams(text) is not None
        lang, _, cosine = self.predict(text)
        return lang != UNDETERMINED and cosine >= bound


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = 1024, n: int = 3, seed: int = 7) -> Profiles:
    """Learn a prototype for each value of ``lang_col`` from all rows of ``docs``.

    Rows whose language or text is null, or whose text has no letter, teach
    nothing.  Each task adds up one vector per language; only languages times
    dimensions numbers reach the driver, however many rows there are.  Sums
    are of whole numbers, so they don't depend on the order of the rows.
    """

    schema = "lang string, dim int, value bigint"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches_of(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                vector = space(dims, n, seed).bundle(text.as_py())
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(range(dims), pa.int32()), pa.array(np.rint(vector).astype(np.int64))], schema=fields)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    totals = rows.mapInArrow(run, schema).groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in totals})
    sums = np.zeros((len(langs), dims))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in totals:
        sums[place[r.lang], r.dim] = r.value
    return Profiles(langs, sums, dims, n, seed)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of the whole text of every row.

    ``und`` with score 0 if the text is null, empty or has no letter.  Ties go to the
    first language in order of name.  Repeated rows give repeated results, a
    null id stays null, and other columns aren't read.
    """
    fields = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            yield record_batch([(i, h, *profiles.predict(t.as_py())) for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)], fields)

    return docs.select(F.col(id_col).cast("bigint"), held_out(id_col).alias("held"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def learn_and_identify(docs: DataFrame, **parameters) -> DataFrame:
    """Train on the rows that aren't held out; predict for all rows."""
    return identify(docs, train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), **parameters))


def filter_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", chance: float = CHANCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language.

    Rejected are texts that are null or have no letter, and texts as far from
    every prototype as chance: the cosine of two random vectors varies by
    ``1 / sqrt(dims)``, and a text must come nearer to some language than
    ``chance`` times that.  Where no language was learned, texts with a letter
    stay.  Repeated rows stay or go alike.
    """
    place, bound = docs.columns.index(text_col), chance / profiles.dims**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            yield b.filter(pa.array([profiles.identified(t.as_py(), bound) for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
