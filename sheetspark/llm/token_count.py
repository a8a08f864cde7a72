"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A pre-token starts as one symbol per byte. A heap holds the adjacent pairs that a merge rule names, lowest rank
and then leftmost first; merging relinks the neighbours. The count is the symbols at first less the merges.

Defined results: null and empty texts count 0; special strings inside a text count 1, as the file's library has
it by default; repeated rows each count; an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import CACHE_CHARS, CACHE_SIZE, byte_characters, python_pattern
from .common import arrow_schema


class Counts:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in byte_characters()]
        rules = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(rules)}
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(python_pattern(pattern)).findall
        self.cache: dict[str, int] = {}

    def merged(self, token: str) -> int:
        """Symbols left of one pre-token."""
        symbol = [self.first[b] for b in token.encode()]
        count, rules = len(symbol), self.rules
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        end = count
        heap = [(found[0], i, found[1], symbol[i], symbol[i + 1]) for i in range(count - 1) if (found := rules.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= end or symbol[j] != right:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            count -= 1
            if k < end:
                before[k] = i
                if found := rules.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k]))
            if (h := before[i]) >= 0 and (found := rules.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], symbol[h], new))
        return count

    def _plain(self, text: str) -> int:
        total, cache = 0, self.cache
        for token, times in Counter(self.split(text)).items():
            n = cache.get(token)
            if n is None:
                n = self.merged(token)
                if len(token) <= CACHE_CHARS:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[token] = n
            total += n * times
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def counts(path: str, pattern: str) -> Counts:
    return Counts(path, pattern)


def count_tokens(docs: DataFrame, vocab_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes of the UTF-8 text, n_tokens, over_limit (more tokens than limit)."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counts(vocab_path, pattern)
        for batch in batches:
            n = [counter.count(text.as_py() or "") for text in batch.column(1)]
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    bytes_ = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(F.col(id_col), F.col(text_col), bytes_.alias("n_bytes")).mapInArrow(run, schema)
