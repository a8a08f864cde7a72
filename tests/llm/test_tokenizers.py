import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sheetspark.llm.bpe_codec import Codec, decode_ids, encode_documents
from sheetspark.llm.token_count import Counts, count_tokens

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(7)
    out = ["", " ", "\n\n  \t x", "it's we'll they'RE", "a\x1cb \x1f c\x85d e　f g", "ab" * 4000, "日本語 テキスト 123456", "<|endoftext|> a<|endoftext|><|endoftext|>b", "é́\U0001f600\U0001f468‍\U0001f469", "  many   spaces   ", "x" * 1000 + " " * 500 + "!" * 300]
    for _ in range(300):
        out.append("".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0x80), rng.randrange(0x370, 0x3000), 32, 10, rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 120))))
    return out


def test_codec_is_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(MULTI, P.PATTERN)
    every = "".join(chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000)
    for t in [*texts(), every]:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t), t[:80]
        assert codec.decode(ids) == t.encode()


def test_counts_are_the_library():
    own = Tokenizer.from_file(JSON)
    counter = Counts(JSON, P.PATTERN)
    every = "".join(chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000)
    for t in [*texts(), every]:
        assert counter.count(t) == len(own.encode(t, add_special_tokens=False).ids), t[:80]


def test_queries_on_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "a\nb", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_documents(df, MULTI, P.PATTERN, with_ids=True)
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.n_tokens for r in got][:2] == [0, 0]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2] == got[3] and got[2].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    back = decode_ids(out, MULTI, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    n = {(r.doc_id, r.n_bytes, r.over_limit) for r in count_tokens(df, JSON, P.PATTERN).collect()}
    assert n == {(1, 0, False), (2, 0, False), (3, 11, False), (None, 3, False)}
    empty = df.limit(0)
    assert encode_documents(empty, MULTI, P.PATTERN).count() == 0 and count_tokens(empty, JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_codec_other_vocabulary(name):
    codec = Codec(P.path(name), P.PATTERN)
    assert codec.decode(codec.encode("The quick brown fox")) == b"The quick brown fox"
