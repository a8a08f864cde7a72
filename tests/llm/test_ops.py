"""Each operator on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing names; brute force where SQL has no words for it."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.llm import language_id, line_dedup, mixing, mpeg_audio, near_dup, quality_fm, quality_mcd, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def odd_rows(rng):
    same = prose(rng, 120)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, same, "en", "a"), (3, same, "en", "a"), (4, same, "en", None), (None, prose(rng, 60), "en", "b"), (5, "word " * 3000, "de", "b"), (6, " \n\t ", "de", None), (7, same.replace(" ", "\n"), None, "c")]
    return rows + [(100 + i, prose(rng, rng.randrange(40, 200)), "en", "abc"[i % 3]) for i in range(40)]


def test_mix(spark):
    rows = odd_rows(random.Random(1))
    df = docs(spark, rows)
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    total = sum(size.values())
    weight = {s: w for s, w in zip(sorted((x for x in size if x is not None)) + [None], (1, 2, 3, 1))}
    target, open_ = {}, set(size)
    left = float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    by_id = {i: s for i, _, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[by_id[r.doc_id]] and abs(r.target - target[by_id[r.doc_id]]) < 1e-6
        taken[by_id[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 * 3 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(df.repartition(5)).collect()))
    made = mixing.mix_documents(df)
    assert made.columns == df.columns
    words = Counter()
    for r in made.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mixing.mix_counts(df.limit(0)).count() == 0


def test_line_dedup(spark):
    shared, near = "the same line on many sites", "a line on nine sites"
    rows = [(i, f"own {i}\n{shared}\n\n" + (near if i < 9 else "x"), "en", f"s{i}") for i in range(12)] + [(50, None, "en", "s1"), (51, "", "en", None), (52, f"{shared}\n{shared}", "en", "s2"), (52, f"{shared}\n{shared}", "en", "s2"), (None, shared, "en", "s3")]
    out = line_dedup.remove_boilerplate(docs(spark, rows), count_col="gone_lines").collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(rows) and shared in by[0][0].text and by[0][0].gone_lines == 0
    assert by[3][0].text == f"own 3\n\n{near}" and by[3][0].n_chars == len(by[3][0].text)
    assert by[50][0].text is None and by[51][0].text == "" and [r.text for r in by[52]] == ["", ""] and by[None][0].text == ""
    assert line_dedup.line_report(docs(spark, rows).limit(0)).count() == 0


def test_near_dup_is_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, 150) for _ in range(12)]
    rows, n = [], 0
    for t in base:
        for _ in range(rng.choice([1, 2, 30])):
            w = t.split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((n, " ".join(w), "en", "a"))
            n += 1
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "Two words", "en", "a"), (903, "two WORDS", "en", "a"), (5, rows[5][1], "en", "a"), (None, base[0], "en", "a")]
    got = near_dup.classes(docs(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t, _, _ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        if i is not None:
            sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    one = near_dup.keep_one(docs(spark, rows), 3, 85)
    assert one.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({find(i) for i in sets})


@pytest.mark.parametrize(("k", "percent", "changed"), [(3, 85, 7), (5, 80, 6)])
def test_near_dup_in_one_large_group(spark, k, percent, changed):
    rng = random.Random(8)
    base = prose(rng, 400).split()
    rows, sets, at = [], [], {}
    for i in range(1200):
        w = list(base)
        for j in rng.sample(range(400), changed):
            w[j] = prose(rng, 2).replace(" ", "") + str(i)
        rows.append((i, " ".join(w), "en", "a"))
        sets.append(sum(1 << at.setdefault(x, len(at)) for x in {tuple(w[j : j + k]) for j in range(401 - k)}))
    root = list(range(1200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    # the vocabulary is cut to what more than one set has, which alone counts for intersections
    size = [s.bit_count() for s in sets]
    once, many = 0, 0
    for s in sets:
        many |= once & s
        once |= s
    base_bits = {b: n for n, b in enumerate(b for b in range(many.bit_length()) if many >> b & 1)}
    short = [sum(1 << n for b, n in base_bits.items() if s >> b & 1) for s in sets]
    for a in range(1200):
        for b in range(a + 1, 1200):
            both = (short[a] & short[b]).bit_count()
            if 100 * both >= percent * (size[a] + size[b] - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert 1 < len({find(i) for i in range(1200)}) < 1200
    got = near_dup.classes(docs(spark, rows), k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(1200)}


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 6000, 7000)]
    got = near_dup.intersections(sets[:3], sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:3]]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    assert {(r.id, r.label) for r in near_dup.components(chain).collect()} == {(i, 0) for i in range(31)} | {(50, 50), (60, 50)}


def test_mcd(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(60, 200)), "en", "a") for i in range(90)]
    rows += [(500, " ".join(w + "###$$$%%%" for w in prose(rng, 80).split()), "en", "a"), (501, None, "en", "a"), (502, "few words", None, None), (503, "same again now " * 40, "en", "a")]
    got = {r.doc_id: r for r in quality_mcd.judge(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(90))
    assert not got[500].kept and not got[500].base_failed and got[501].base_failed and got[502].base_failed and got[503].base_failed
    assert (got[503].n_words, got[503].n_repeat_words) == (120, 120)


def test_mcd_statistics():
    rng = random.Random(9)
    for _ in range(100):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\x0b", "c "]) for _ in range(rng.randrange(0, 80)))
        w = text.encode().split()
        three = Counter(zip(w, w[1:], w[2:]))
        repeat = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(w), sum(len(x.decode()) for x in w), text.count("#"), len(lines) - len(set(lines)), len(repeat))
        assert quality_mcd.statistics(text) == want


def test_language(spark):
    rng = random.Random(2)
    make = {"xx": "abcdefg", "yy": "stuvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(make[x]) for _ in range(5)) for _ in range(30)), x, "a") for i in range(40) for x in ("xx",)]
    rows += [(100 + i, " ".join("".join(rng.choice(make["yy"]) for _ in range(5)) for _ in range(30)), "yy", "a") for i in range(40)]
    rows += [(200, None, "xx", "a"), (201, "123 ½ !!", "xx", "a"), (202, "sturz wuyz", None, "a")]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == "xx" for i in range(40)) and all(got[100 + i].lang_pred == "yy" for i in range(40))
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[202].lang_pred == "yy"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs(spark, [(1, "text", None, "a")])).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80) if i % 4 else "BUY!! " * 60, "en", "a") for i in range(120)] + [(500, None, "en", "a"), (500, None, "en", "a"), (501, "", None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    got = quality_fm.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == int(r.doc_id % 4 > 0) for r in got if r.doc_id < 120 and r.held_out]
    assert sum(right) >= 0.9 * len(right)
    kept = quality_fm.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id < 120 and doc_id % 4 = 0").count() <= 3
    assert {r.predicted for r in quality_fm.classify(df, labels.limit(0)).collect()} == {1}


def test_machine_identity():
    rng = quality_fm.np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SLOTS), rng.normal(size=(quality_fm.SLOTS, quality_fm.RANK)) * 0.1)
    i, x = quality_fm.features("some words and Some more words!")
    z = m.w0 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert abs(m.scores([(i, x)])[0] - 1 / (1 + quality_fm.np.exp(-z))) < 1e-9


def test_warc(spark, tmp_path):
    big = "<html>" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/1\nb", big), (2, "http://a/2", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (6, "u", "é" * 600), (2, "http://a/2", big)], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_pages(pages, path).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == [(1, 1206, "revisit", 2, sha(big)), (2, 1206, "response", None, sha(big)), (2, 1206, "response", None, sha(big)), (3, 5, "response", None, sha("small")), (4, 5, "response", None, sha("small")), (5, 0, "response", None, sha("")), (6, 1200, "response", None, sha("é" * 600))]
    some = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert some.count() == 1 and some.first().payload is None
    assert warc.read_warc(spark, path, payload=False).where(F.col("target_uri").isin("http://a/4", "u")).count() == 3
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_of_others(spark, tmp_path, zipped):
    import gzip

    parts = [warc.record(k, f"urn:page:{i}", f"http://h/{i}", "2020-01-01T00:00:00Z", hashlib.sha1(b"p" * i).hexdigest(), None, i, b"p" * i) for i, k in enumerate(("response", "response", "metadata"), 70000)]
    (tmp_path / ("x.warc.gz" if zipped else "x.warc")).write_bytes(b"".join(map(gzip.compress, parts)) if zipped else b"".join(parts))
    got = warc.read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert sorted((r.payload_bytes, r.payload_sha1) for r in got) == sorted((i, hashlib.sha1(b"p" * i).hexdigest()) for i in (70000, 70001)) and all(r.payload_digest == r.payload_sha1 for r in got)


def test_mpeg(spark):
    rng = random.Random(8)
    for n in (64, 1408, 1472, 50_048):
        payload = bytes(rng.randrange(256) for _ in range(n))
        media = mpeg_audio.write(payload)
        s = mpeg_audio.parse(media)
        assert mpeg_audio.payload_of(media, s) == payload and s.bad_crc == s.resyncs == 0 and s.table["frames"] == len(s.offsets)
        assert s.duration * 32000 == len(s.offsets) * 1152 and s.offsets[-1] + s.sizes[-1] == len(media)
    damaged = bytearray(media)
    damaged[s.offsets[5] + 8] ^= 0xFF
    d = mpeg_audio.parse(bytes(damaged))
    assert d.bad_crc == 1 and len(d.offsets) == len(s.offsets) - 1
    junk = mpeg_audio.parse(media[: s.offsets[3]] + b"\xff\xfbjunk" * 9 + media[s.offsets[3] :] + b"TAG" + bytes(125))
    assert len(junk.offsets) == len(s.offsets) and junk.resyncs >= 1
    got = {r.doc_id: r for r in mpeg_audio.store_texts(docs(spark, odd_rows(rng)), with_media=True).collect()}
    assert got[1].payload_bytes == 64 and got[1].n_bytes == 0 and got[1].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert got[3].media_sha256 == got[4].media_sha256 == hashlib.sha256(got[3].media).hexdigest() and got[1].tail_crc32 == zlib.crc32(bytes(64))
    assert mpeg_audio.store_texts(docs(spark, []).limit(0)).count() == 0
