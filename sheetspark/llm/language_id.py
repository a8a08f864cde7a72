"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 characters of words with a space on
either side) in order. A document's own list is compared with each: every n-gram adds how far out of place it is,
or the length of a profile where the language lacks it. The nearest profile wins, ties by language.

Profiles are counted over all training rows: tasks count n-grams, Spark sums them, and only the fixed number of
n-grams a language comes to the driver. Counts are exact.

Defined results: null text or text without a letter: `und`, score 0; so is every text if nothing was learned;
rows with null lang are not learned from; repeated rows each count and each get a row; n-grams of equal counts rank by
key, languages of equal distance by name; very long texts and large alphabets take memory in proportion to the text;
an empty table gives an empty table; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, held_out

WORDS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
#: Counters for the n-grams of one text, 8 MB of them; where there could be more, n-grams are sorted.
COUNTERS = 1 << 20


def letters(word: str) -> str:
    """The word's letters: numerals such as fractions are not letters though the pattern has them."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's n-grams in order, 21 bits a character so that equal keys are equal n-grams, and how often each comes.

    The words stand with one space between; an n-gram of three never has the space in its middle.
    """
    words = WORDS(text.lower())
    joined = " ".join(words)
    if words and not joined.replace(" ", "").isalpha():
        joined = " ".join(w for x in words if (w := letters(x)))
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    seen = np.bincount(codes) > 0
    chars = np.flatnonzero(seen)  # the space comes first
    at = (np.cumsum(seen) - 1)[codes]
    k = len(chars)
    two, middle = at[:-1] * k + at[1:], at[1:-1] > 0
    three = (two[:-1] * k + at[2:])[middle]
    one = np.bincount(at, minlength=k)
    one[0] = 0
    a = np.flatnonzero(one)
    (b, pairs), (c, triples) = _counted(two, k * k), _counted(three, k * k * k)
    keys = np.concatenate([chars[a], chars[b // k] << 21 | chars[b % k], chars[c // (k * k)] << 42 | chars[c // k % k] << 21 | chars[c % k]])
    return keys, np.concatenate([one[a], pairs, triples])


def _counted(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below span and their counts: by counters while those are few, else by sorting, so memory goes with the text."""
    if span > COUNTERS:
        return np.unique(values, return_counts=True)
    n = np.bincount(values, minlength=1)
    found = np.flatnonzero(n)
    return found, n[found]


def gram_of(key: int) -> str:
    out = ""
    while key:
        out, key = chr(key & 0x1FFFFF) + out, key >> 21
    return out


def train(docs: DataFrame, size: int = 400, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram (its key), place (0: most frequent; ties by key) over all rows whose lang and text are not null."""
    schema = "lang string, gram long, n long"
    fields = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, []).append(gram_counts(text.as_py()))
            for lang, parts in found.items():
                keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], schema=fields)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    grams = rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return grams.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.keys = np.array(sorted({g for _, g, _ in rows}), np.int64)
        self.places = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.keys, gram), self.langs.index(lang)] = place

    def top(self, text: str) -> np.ndarray:
        """The text's most frequent n-grams, ties by key."""
        keys, n = gram_counts(text)
        return keys[np.argsort(-n, kind="stable")[: self.size]]

    def predict(self, text: str | None) -> tuple[str, float]:
        top = self.top(text or "") if self.langs else ()
        if not len(top):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        theirs = np.where((self.keys[at] == top)[:, None], self.places[at], -1)
        far = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.size * len(top))


def predict(docs: DataFrame, profiles: Profiles, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, held_out boolean, lang_pred string, score double"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text.as_py()) for text in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col)).mapInArrow(run, schema)


def identify(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, then predicts every row."""
    held = held_out(F.col(id_col))
    learned = train(docs.where(~held), size, text_col, lang_col)
    rows = [tuple(r) for r in learned.collect()]  # size rows a language
    return predict(docs, Profiles(rows, size), held, id_col, text_col)
