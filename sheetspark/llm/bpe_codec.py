"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a rank file.

Each vocabulary entry becomes a piece in which every byte is one printable character, its score the negative
rank; normalisation is the identity. sentencepiece then merges the adjacent pair whose piece has the highest
score, leftmost first, which is the lowest rank: the same merges as the rank file's own library. As there, a
pre-token that is itself an entry is that entry, whether or not merges would reach it.

Defined results: null and empty texts have no ids; white-space runs, ties, repeated rows and very long
pre-tokens need no special case (merging is n log n); an empty table gives an empty table; the columns of the
input other than the two named are dropped, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

#: Pre-tokens of more characters are not kept in the cache, and the cache starts anew at so many.
CACHE_CHARS, CACHE_SIZE = 64, 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100."""
    plain = set(chain(range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)))
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece model; entries by rank, whose ids are their ranks. The unknown piece comes last."""
    chars = byte_characters()
    out = []
    for rank, entry in enumerate(entries):
        piece = "".join(chars[b] for b in entry).encode()
        out.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -rank)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def python_pattern(pattern: str) -> str:
    """The pattern for the regex module, whose \\s has U+001C..U+001F besides Unicode's white space."""
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out.append(space if inside else f"[{'^' * (two[1] == 'S')}{space}]")
            at += 2
            continue
        if two[0] == "\\":
            out.append(two)
            at += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(two[0])
        at += 1
    return "".join(out)


class Codec:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.entries = [b""] * len(ranks)
        for entry, rank in ranks.items():
            self.entries[rank] = entry
        self.ranks = ranks
        self.split = regex.compile(python_pattern(pattern)).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.entries))
        self.to_chars = dict(enumerate(byte_characters()))
        self.cache: dict[str, tuple] = {}

    def _learn(self, tokens: list[str]) -> dict[str, tuple]:
        """Ids, the ids as text and the decoded bytes of pre-tokens that the cache does not hold."""
        raw = [t.encode() for t in tokens]
        whole = [self.ranks.get(b) for b in raw]
        rest = [b.decode("latin-1").translate(self.to_chars) for b, w in zip(raw, whole) if w is None]
        parts = iter(self.sp.encode(rest, out_type=int, num_threads=1) if rest else ())
        found = {}
        for t, w in zip(tokens, whole):
            ids = [w] if w is not None else next(parts)
            found[t] = (tuple(ids), ",".join(map(str, ids)), self.decode(ids))
        return found

    def decode(self, ids) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in ids])

    def encode_parts(self, text: str) -> list[tuple]:
        tokens = self.split(text)
        cache = self.cache
        missing = [t for t in set(tokens) if t not in cache]
        if missing:
            new = self._learn(missing)
            if len(cache) + len(new) > CACHE_SIZE:
                cache.clear()
                new = self._learn(list(set(tokens)))
            short = {t: v for t, v in new.items() if len(t) <= CACHE_CHARS}
            cache.update(short)
            if len(short) < len(new):
                return [new[t] if t in new else cache[t] for t in tokens]
        return [cache[t] for t in tokens]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.encode_parts(text)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, digests of the ids and of the bytes decoded from them; with_ids adds ids and decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab_path, pattern)
        for batch in batches:
            n, ids_hash, text_hash, flat, ends = [], [], [], array("i"), [0]
            for text in batch.column(1):
                parts = coder.encode_parts(text.as_py() or "")
                n.append(sum(len(p[0]) for p in parts))
                ids_hash.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                if with_ids:
                    for p in parts:
                        flat.extend(p[0])
                    ends.append(len(flat))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, vocab_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for; null ids give null."""
    schema = rows.withColumn(out_col, F.lit(None).cast("binary")).schema
    fields, at = arrow_schema(schema), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab_path, pattern)
        for batch in batches:
            out = pa.array([None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, out], fields)], schema=fields)

    return rows.mapInArrow(run, schema)
