"""Every stage of the pipeline against plain Python, on documents with null and empty texts, repeated ids and clashing column names."""

import base64
import random
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from sheetspark.llm import mixing, quality_fm
from sheetspark.llm.queries import SITES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _score double, _text string, _id string, id long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def documents():
    rng = random.Random(12)
    line = "the same line at the foot of many pages"
    rows = []
    for i in range(90):
        text = "BUY!! NOW!! " * rng.randrange(10, 40) if i % 4 == 0 else prose(rng, rng.randrange(20, 120))
        rows.append((i, text + (f"\n{line}" if i % 5 == 1 else ""), "en", f"s{i % 9}" if i % 3 else "hot"))
    for i in range(12):  # near copies
        w = rows[1 + 4 * (i % 3)][1].split(" ")
        w[rng.randrange(len(w) - 1)] = "other"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300, None, "en", "s1"), (301, "", "de", None), (302, rows[2][1], "en", None), (302, rows[2][1], "en", None), (None, prose(rng, 40), "en", "s2"), (303, "é" * 30_000, "fr", "s3")]
    return [(i, t, lang, s, len(t or ""), 0.5, "x", "y", 7) for i, t, lang, s in rows]


def test_stages_are_brute_force(spark, tmp_path):
    rng = random.Random(1)
    labels = [(i, int(i % 4 > 0), 0) for i in range(90)]
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = documents()
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, COLUMNS)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        path = f"{sf}/{name}"
        stages[name](spark, df, sf).write.parquet(path)
        out = spark.read.parquet(path)
        return out, [tuple(r) for r in out.collect()]

    # quality: rows at or above the threshold of the fitted machine
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {t: float(machine.scores([quality_fm.features(t)])[0]) for t in {r[1] for r in rows}}
    good, got = run("quality_classifier", docs)
    assert good.columns == names and sorted(map(str, got)) == sorted(str(r) for r in rows if score[r[1]] >= 0.7)
    assert {r[0] for r in got} >= {i for i in range(90) if i % 4} and not {r[0] for r in got} & {i for i in range(90) if i % 4 == 0}

    # lines: on many sites stay in the least document
    sites, keeper = defaultdict(set), {}
    for r in got:
        for x in (r[1] or "").split("\n"):
            if x.strip(" \t\n\v\f\r"):
                sites[x].add(r[3])
                keeper[x] = min(keeper.get(x, float("inf")), r[0] if r[0] is not None else float("inf"))
    gone = {x for x, s in sites.items() if len(s - {None}) >= SITES}
    assert gone
    want = []
    for r in got:
        text = r[1]
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if x not in gone or r[0] == keeper[x])
        want.append((r[0], text, r[2], r[3], len(text or ""), *r[5:]))
    clean, got = run("line_dedup", good)
    assert clean.columns == names and sorted(map(str, got)) == sorted(map(str, want))

    # near copies: five words, .8
    sets = {}
    for r in got:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        if r[0] is not None:
            sets[r[0]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    once, after = run("minhash_near_dedup", clean)
    assert once.columns == names and sorted(r[0] for r in after if r[0] is not None) == sorted({find(i) for i in sets}) and sum(r[0] is None for r in after) == 1
    assert {str(r) for r in after} <= {str(r) for r in got}

    # the mix: each row's words are its document's, in order; what is taken of each document is what the counts say
    taken = Counter()
    for r in mixing.mix_counts(once).collect():
        taken[r.doc_id] += r.taken
    texts = {r[0]: r[1] for r in after}
    mixed, got = run("source_mix", once)
    assert mixed.columns == names
    made = Counter()
    for r in got:
        words = iter(texts[r[0]].split())
        assert all(w in words for w in r[1].split()) and r[4] == len(r[1])
        made[r[0]] += len(r[1].split())
    assert +made == +taken

    # tokens: as the tokenizer's own library gives them
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = stages["byte_bpe"](spark, mixed, sf).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded) == sorted((str(r[0]), codec.encode_ordinary(r[1])) for r in got)


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
