"""License statements by exact set-similarity join (operator 9).

Text blocks meet license templates where a block holds at least ``threshold``
of a template's distinct words.  Blocks are lines, and for statements wrapped
over line ends all runs of as many words as the template has, wherever lines
end.  Template words are ordered by the number of documents of the whole corpus
that hold them, rarest first.  An index leads from each word of a template's
*prefix* (its first ``n - need + 1`` words, of which a block must hold one) to
the template and the word's place.  A block looks its words up in that index
and leaves out the templates that can't be met: by *length* (it must have
``need`` words of templates) and by *position* (what is left of the block and of the template
from their first common word on must both suffice).  The overlap is then
counted.  A document as a whole goes through the same index and filters; of the
templates that are left, its runs are looked at.  All of it is
DataFrame functions on one row per document: nothing is shuffled but one count
per template word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base contract, and templates of the method.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("all-rights-reserved", "all rights reserved"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def lowered(text: Column) -> Column:
    """Text with A-Z in lower case.

    Other letters may change too: they are word characters before and after
    and stand in no phrase.  But for two characters (U+0130 and U+212A), whose
    lower case has ASCII letters; texts with them take the slower way.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _spaced(low: Column) -> Column:
    """The words, each with one space before it, and a space at the end."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(low, F.lit(" ")), NOT_WORD, " ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def needed(n: int, threshold: float) -> int:
    """The least overlap with a template of ``n`` words."""
    return max(1, math.ceil(n * threshold - 1e-9))


def block_words(block: Column) -> Column:
    """The distinct words of a lower-cased block."""
    return F.array_remove(F.array_distinct(F.split(_spaced(block), " ")), "")


class Index:
    """Templates with their words in global order, and where their prefix words lead."""

    def __init__(self, count: dict[str, int], templates=TEMPLATES, threshold: float = 0.8) -> None:
        rank = lambda w: (count.get(w, 0), w)
        self.labels = [label for label, _ in templates]
        self.widths = [len(t.split()) for _, t in templates]
        self.words = [sorted(set(t.split()), key=rank) for _, t in templates]
        self.needs = [needed(len(w), threshold) for w in self.words]
        self.vocabulary = sorted({w for own in self.words for w in own}, key=rank)
        self.prefix: dict[str, list[tuple[int, int]]] = {}
        for k, (own, need) in enumerate(zip(self.words, self.needs, strict=True)):
            for place, w in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((k, place))

    def common(self, words: Column) -> Column:
        """The words of templates among ``words``, in global order."""
        return F.array_intersect(_array(self.vocabulary), words)

    def may_meet(self, low: Column) -> Column:
        """Whether a lower-cased text has a prefix word, as a word or in one."""
        return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in sorted(self.prefix)])

    def candidates(self, common: Column) -> Column:
        """Numbers of the templates that the words ``common`` (of templates, in global order) may meet."""
        entry = lambda k, place: F.struct(F.lit(k).alias("k"), F.lit(len(self.words[k]) - place).alias("left"), F.lit(self.needs[k]).alias("need"))
        index = F.create_map(*[c for w, found in sorted(self.prefix.items()) for c in (F.lit(w), F.array(*[entry(*f) for f in found]))])

        def of_word(word: Column, place: Column) -> Column:
            met = F.filter(F.coalesce(F.element_at(index, word), F.array().cast("array<struct<k:int,left:int,need:int>>")), lambda e: (F.size(common) >= e["need"]) & (F.least(e["left"], F.size(common) - place) >= e["need"]))
            return F.transform(met, lambda e: e["k"])

        return F.array_distinct(F.flatten(F.transform(common, of_word)))

    def met(self, ks: Column, overlap) -> Column:
        """(label, containment) of the templates ``ks`` whose ``overlap`` (a function of the number) suffices."""
        at = lambda values: lambda k: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
        need, label, size = at(self.needs), at(self.labels), at([float(len(w)) for w in self.words])
        counted = F.transform(ks, lambda k: F.struct(k.alias("k"), overlap(k).alias("n")))
        counted = F.filter(counted, lambda c: c["n"] >= need(c["k"]))
        return F.transform(counted, lambda c: F.struct(label(c["k"]).alias("label"), (c["n"].cast("double") / size(c["k"])).alias("containment")))

    def own(self, k: Column) -> Column:
        return F.element_at(F.array(*[_array(w) for w in self.words]), k + 1)

    def width(self, k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in self.widths]), k + 1)

    def of_lines(self, low: Column) -> Column:
        """(label, containment) of all lines and templates that meet."""
        lines = F.filter(F.split(low, "\n"), self.may_meet)
        words = F.filter(F.transform(lines, lambda line: self.common(block_words(line))), lambda common: F.size(common) > 0)
        return F.flatten(F.transform(words, lambda common: self.met(self.candidates(common), lambda k: F.size(F.array_intersect(self.own(k), common)))))

    def of_runs(self, spaced: Column) -> Column:
        """(label, containment) of the templates that some run of as many words meets."""
        words = F.transform(F.split(F.trim(spaced), " "), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
        places = F.filter(words, lambda h: h["word"].isin(self.vocabulary))
        # once: places are wanted for each candidate
        return F.flatten(F.transform(F.array(places), lambda ps: self.met(self.candidates(self.common(ps["word"])), lambda k: self._fullest(ps, k))))

    def _fullest(self, places: Column, k: Column) -> Column:
        """The most distinct words of template ``k`` in a run of its length, in one pass over their places."""

        def step(state: Column, h: Column) -> Column:
            recent = F.filter(state["recent"], lambda r: (r["at"] > h["at"] - self.width(k)) & (r["word"] != h["word"]))
            recent = F.concat(recent, F.array(h))
            return F.struct(recent.alias("recent"), F.greatest(state["most"], F.size(recent)).alias("most"))

        start = F.struct(F.array().cast("array<struct<word:string,at:int>>").alias("recent"), F.lit(0).alias("most"))
        return F.aggregate(F.filter(places, lambda h: F.array_contains(self.own(k), h["word"])), start, step, lambda state: state["most"])


def build_index(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8) -> Index:
    """The index of the templates, their words ordered by the documents that hold them.

    Counts cover every word of every document; the driver gets one row per
    word of the templates, which are constants.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    words = F.split(F.trim(_spaced(lowered(F.col(text_col)))), " ")
    held = docs.select(F.explode(F.array_intersect(_array(vocabulary), words)).alias("word"))
    return Index({r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}, templates, threshold)


def scan(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` with the licenses that its whole text states.

    ``n_base`` counts the places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest start among them (words from 0,
    null without any), ``base_labels`` and ``labels`` are sorted and joined by
    commas, and ``score`` is 1 where a base phrase stands, else the largest
    containment that met the threshold, else 0.  Null texts count as empty,
    repeated rows give repeated results, and other columns aren't read.
    """
    index = build_index(docs, text_col, templates, threshold)
    none = F.array().cast("array<struct<label:string,containment:double>>")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lowered(F.col(text_col)).alias("low"))
    rows = rows.select("doc_id", "low", _spaced(F.col("low")).alias("spaced")).withColumn("n_words", (_spaces(F.col("spaced")) - 1).cast("bigint"))
    low, spaced = F.col("low"), F.col("spaced")
    runs = F.when(F.contains(low, F.lit("\n")), index.of_runs(spaced)).otherwise(none)  # a single line is a block itself
    rows = rows.withColumn("met", F.when(index.may_meet(low), F.concat(index.of_lines(low), runs)).otherwise(none))
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in PHRASES.items():
        held, size = f" {phrase} ", len(phrase.split())
        there = F.contains(spaced, F.lit(held))
        wide, mark = F.replace(spaced, F.lit(" "), F.lit("  ")), held.replace(" ", "  ")[1:-1]
        n = (F.length(wide) - F.length(F.replace(wide, F.lit(mark), F.lit("")))) / len(mark)
        counts.append(F.when(there, n.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        firsts.append(F.when(there, _spaces(F.substring_index(spaced, held, 1)).cast("bigint")))
        lasts.append(F.when(there, F.col("n_words") - size - _spaces(F.substring_index(spaced, held, -1)).cast("bigint")))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    n_base = sum(counts[1:], counts[0])
    best = F.coalesce(F.array_max(F.col("met.containment")), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("met.label"))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: lines, and runs from each word of a template on."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({k}, '{label}', {len(t.split())}, {sorted(set(t.split()))!r}, {needed(len(set(t.split())), threshold)})" for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', {p.split()!r})" for label, p in PHRASES.items())
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM low),
phrases(label, p) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, greatest(0, len(ws) - len(p) + 1)), lambda i: ws[i + 1:i + len(p)] = p)) AS i
  FROM w, phrases WHERE contains(ws, p[1])),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
templates(k, label, width, ts, need) AS (VALUES {values}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(b, '{word}')) AS bs FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS b FROM low)),
runs AS (
  SELECT doc_id, label, ts, need, unnest(list_transform(list_filter(range(0, len(ws)), lambda i: list_contains(ts, ws[i + 1])), lambda i: list_distinct(ws[i + 1:i + width]))) AS bs
  FROM w, templates WHERE contains(t, chr(10)) AND len(list_intersect(list_distinct(ws), ts)) >= need),
met AS (
  SELECT doc_id, label, len(list_intersect(bs, ts))::DOUBLE / len(ts) AS c FROM blocks, templates WHERE len(list_intersect(bs, ts)) >= need
  UNION ALL SELECT doc_id, label, len(list_intersect(bs, ts))::DOUBLE / len(ts) FROM runs WHERE len(list_intersect(bs, ts)) >= need),
own AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS ls FROM met GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(own.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""
