"""The methods themselves against plain Python: permutations, block joins, distances, fits, hand-made streams."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sheetspark.llm import language_id, line_dedup, mixing, mpeg_audio, near_dup, quality_fm, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


# ---- mixing


def test_index_is_a_permutation_without_small_strides(spark):
    counts = [1, 2, 3, 5, 7, 16, 63, 64, 65, 100, 257, 1000, 4097, 20_000]
    slots = spark.createDataFrame([(n,) for n in counts], "blocks long").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("blocks") - 1)))
    got = slots.select("blocks", "slot", mixing._index(F.col("slot"), F.lit("1a"), F.col("blocks"), 17).alias("at")).toPandas()
    for n, part in got.groupby("blocks"):
        at = part.sort_values("slot")["at"].to_numpy()
        first, second = at[:n], at[n:]
        assert sorted(first) == sorted(second) == list(range(n))
        if n >= 1000:
            assert (first != second).mean() > 0.9  # another permutation for each pass
            steps = Counter((np.diff(first) % n).tolist())
            assert max(steps.values()) < 0.02 * n  # an affine map has one step only
            assert np.abs(np.diff(first)).mean() > n / 4  # a random one has n / 3


def test_blocks_are_taken_as_slots_say(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 90)) if i % 9 else None, "en", "abc"[min(2, i % 7)]) for i in range(150)] + [(7, prose(rng, 900), "en", "c"), (200, "same words", "en", None), (200, "same words", "en", None)]
    m = mixing.plan(docs(spark, rows), block_words=16, shard_slots=32)
    places = defaultdict(list)  # source -> (start, size, id)
    for r in m.documents.where("size > 0").collect():
        places[r.key].append((r.start, r.size, r.id))
    want, per_shard, drawn = Counter(), Counter(), Counter()
    size = {}
    for key, own in places.items():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[0][0] == 0  # packed without gaps
        size[key] = own[-1][0] + own[-1][1]
    words = {key: [i for start, n, i in sorted(own) for _ in range(n)] for key, own in places.items()}
    for r in m.slots.collect():
        per_shard[r.shard] += 1
        drawn[r.key] += 1
        block = words[r.key][r.block * 16 : r.block * 16 + 16]
        last = r.slot == r.n_slots - 1 and r.last_words > 0
        want.update((r.key, i) for i in (block[: r.last_words] if last else block))
    got = Counter()
    for r in m.taken.collect():
        got[r.key, r.id] += r.words
    assert +got == +want
    total = sum(per_shard.values())
    assert drawn == {r.key: r.n_slots for r in m.sources.collect() if r.n_slots} and all(per_shard[s] == min(32, total - 32 * s) for s in per_shard)


# ---- language profiles


def grams(text):
    found = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {w} "
        found.update(c for c in w if c != " ")
        found.update(w[i : i + 2] for i in range(len(w) - 1))
        found.update(w[i : i + 3] for i in range(len(w) - 2))
    return found


def ranked(counts, size):
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]


def test_language_is_the_brute_force_distance(spark):
    rng = random.Random(11)
    letters = {"xx": "abcdeé", "yy": "cdefgß", "zz": "efghiж"}
    make = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    rows = [(i, make(x, rng.randrange(3, 40)), x, "a") for i, x in enumerate(rng.choice("xyz") * 2 for _ in range(90))]
    rows += [(200, "aaa bbb", None, "a"), (201, None, "xx", "a"), (202, "b a, b-a; B A!", "yy", "a"), (203, "12 ½ _", "yy", "a")]
    size = 60
    totals = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang and t:
            totals[lang].update(grams(t))
    profiles = {x: {g: n for n, g in enumerate(ranked(c, size))} for x, c in totals.items()}
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows), size).collect()}
    for i, t, _, _ in rows:
        own = ranked(grams(t or ""), size)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        far = {x: sum(abs(p[g] - n) if g in p else size for n, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i].lang_pred == best and abs(got[i].score - (1 - far[best] / (size * len(own)))) < 1e-12
    assert language_id.identify(docs(spark, []).limit(0), size).count() == 0


def test_language_of_a_large_alphabet_takes_little_memory():
    text = "".join(chr(c) for c in range(0x4E00, 0x9FA5)) + " " + "".join(chr(c) for c in range(0xAC00, 0xD7A3))
    import tracemalloc

    tracemalloc.start()
    keys, n = language_id.gram_counts(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and dict(zip(keys.tolist(), n.tolist())) == {sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)): k for g, k in grams(text).items()}


# ---- factorisation machine


def test_words_are_hashed_whole():
    a, b = "x" * 300 + "a", "x" * 300 + "b"
    assert quality_fm._word(a)[0] == zlib.crc32(f"w{a}".encode()) % quality_fm.SLOTS != quality_fm._word(b)[0]
    shape = "a9" * 100
    assert quality_fm._word("q1" * 100)[1] == zlib.crc32(f"s{shape}".encode()) % quality_fm.SLOTS
    index, value = quality_fm.features("Same same other")
    words = Counter("Same same other".split())
    norm = sum(n * n for n in words.values()) ** 0.5
    at = {zlib.crc32(f"w{w}".encode()) % quality_fm.SLOTS: n / norm for w, n in words.items()}
    assert all(abs(dict(zip(index[:3].tolist(), value[:3].tolist()))[k] - v) < 1e-12 for k, v in at.items())


def test_fit_is_the_dense_gradient(monkeypatch):
    monkeypatch.setattr(quality_fm, "SLOTS", 30)
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 30, n), rng.normal(size=n)) for n in rng.integers(3, 9, 20)]
    y = (rng.random(20) < 0.6).astype(float)
    got = quality_fm.fit(rows, y, epochs=2, batch=6, rate=0.1, decay=1e-3)
    own = np.random.default_rng(5)
    w0, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(30), own.normal(0, 0.05, (30, quality_fm.RANK))
    g0, gw, gv = 1e-2, np.full(30, 1e-2), np.full((30, quality_fm.RANK), 1e-2)
    for _ in range(2):
        order = own.permutation(20)
        for at in range(0, 20, 6):
            part = order[at : at + 6]
            d0, dw, dv, used = 0.0, np.zeros(30), np.zeros_like(v), set()
            for i in part:
                index, x = rows[i]
                z = w0 + w[index] @ x + sum(v[a] @ v[b] * p * q for k, (a, p) in enumerate(zip(index, x)) for b, q in list(zip(index, x))[k + 1 :])
                e = (1 / (1 + np.exp(-z)) - y[i]) / len(part)
                d0 += e
                total = (v[index] * x[:, None]).sum(0)
                for a, p in zip(index, x):
                    used.add(int(a))
                    dw[a] += e * p
                    dv[a] += e * p * (total - v[a] * p)
            used = sorted(used)
            dw[used] += 1e-3 * w[used]
            dv[used] += 1e-3 * v[used]
            gw += dw * dw
            gv += dv * dv
            g0 += d0 * d0
            w, v, w0 = w - 0.1 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv), w0 - 0.1 * d0 / np.sqrt(g0)
    assert np.allclose(got.w, w) and np.allclose(got.v, v) and abs(got.w0 - w0) < 1e-9


def test_quality_of_odd_tables(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 3 else "BUY!! " * 50, "en", "a") for i in range(60)]
    rows += [(5, f"other text {j}", "en", "a") for j in range(40)] + [(70, "z" * 200_000, "en", "a"), (None, "no id", "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    df = docs(spark, rows)
    one, two = ({(r.doc_id, r.score) for r in quality_fm.classify(d, labels).collect()} for d in (df, df.repartition(7)))
    assert len(one) > 60 and one == two
    assert quality_fm.classify(df.limit(0), labels).count() == 0


# ---- lines


def test_passage_spreads_over_sites_though_one_has_a_third(spark):
    from sheetspark.llm.queries import SITES

    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own text {i}\n{passage}", "en", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(18)]
    rows += [(100 + i, f"copied {i % 2} text\nmore of it {i % 2}", "en", f"s{i}") for i in range(6)]
    out = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs(spark, rows), min_sites=SITES, count_col="gone").collect()}
    assert [i for i in range(18) if passage in out[i].text] == [0] and all(out[100 + i].gone == 0 for i in range(6))


# ---- archives


def test_archive_of_odd_pages(spark):
    big, long = "<html>" + "x" * 1200, "é" * 3_000_000
    pages = spark.createDataFrame([(None, "u", big), (1, "u", big), (None, "v", "y" * 2000), (None, None, "y" * 2000), (3, "w", long), (4, "w", long), (5, "x", "")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_pages(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(None, 1206, "revisit", 1, sha(big)), (1, 1206, "response", None, sha(big)), (None, 2000, "response", None, sha("y" * 2000)), (None, 2000, "response", None, sha("y" * 2000))]
    want += [(3, 6_000_000, "revisit", 4, sha(long)), (4, 6_000_000, "response", None, sha(long)), (5, 0, "response", None, sha(""))]
    assert got == sorted(want, key=str)


def test_ranges_cover_a_file():
    cuts = [0, 5, 9, 20, 22, 30]
    for least in (1, 6, 10, 100):
        got = list(warc._ranges(cuts, least))
        assert got[0][0] == 0 and got[-1][1] == 30 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(b - a >= least for a, b in got[:-1])


# ---- near duplicates


def test_ids_with_several_texts_keep_their_links(spark):
    rng = random.Random(5)
    a, b = prose(rng, 200), prose(rng, 200)
    near = lambda t, j: " ".join([*t.split()[:j], "changed", *t.split()[j + 1 :]])
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, near(a, 50), "en", "s"), (3, near(b, 60), "en", "s"), (4, prose(rng, 50), "en", "s"), (5, None, "en", "s"), (3, "", "en", "s"), (6, prose(rng, 60_000), "en", "s")]
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in near_dup.classes(docs(spark, rows), 3, 85).collect()}
    assert got == {(1, True): (1, True), (2, True): (1, False), (3, True): (1, False), (3, False): (1, False), (4, True): (4, True), (5, False): (5, True), (6, True): (6, True)}
    assert sorted(r.doc_id for r in near_dup.keep_one(docs(spark, rows), 3, 85).collect()) == [1, 4, 5, 6]
    assert near_dup.classes(docs(spark, []).limit(0), 3, 85).count() == 0


# ---- MPEG audio


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ b
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


#: Subbands and the bits of their allocation in Layer II, by the standard's four tables and the one for low rates.
LAYER2 = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


def frame(rng, version, layer, kbits, hz, mode, extension=0, table=None):
    """A protected frame of random bits with a right CRC, from the standard's text."""
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, kbits << 4 | hz << 2, mode << 6 | extension << 4))
    h = mpeg_audio.header(head)
    body = bytearray(rng.randrange(255) for _ in range(h.size - 6))
    channels = 1 if mode == 3 else 2
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 3:
        n = 8 * ((17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17))
    elif layer == 1:
        n = 4 * sum(channels if s < bound else 1 for s in range(32))
    else:
        bits, n, scales = bits_of(body), 0, 0
        for s, width in enumerate(LAYER2[table]):
            for c in range(channels if s < bound else 1):
                if any(bits[n : n + width]):
                    scales += 1 if s < bound else channels
                n += width
        n += 2 * scales
    crc = bitwise_crc(bits_of(head[2:]) + bits_of(body)[:n])
    return head + struct.pack(">H", crc) + bytes(body)


def test_frames_of_every_version_and_layer():
    rng = random.Random(3)
    kinds = [(v, 3, 9, 0, m) for v in (3, 2, 0) for m in (0, 3)] + [(v, 1, 6, 1, m) for v in (3, 2, 0) for m in (0, 1, 3)]
    kinds = [(*k, 1, None) for k in kinds] + [(3, 2, 10, 1, 0, 0, "a"), (3, 2, 5, 0, 3, 0, "a"), (3, 2, 14, 0, 0, 0, "b"), (3, 2, 14, 0, 1, 2, "b"), (3, 2, 2, 0, 3, 0, "c"), (3, 2, 2, 2, 3, 0, "d"), (2, 2, 8, 1, 0, 0, "low"), (0, 2, 8, 1, 1, 0, "low")]
    for kind in kinds:
        frames = [frame(rng, *kind) for _ in range(6)]
        s = mpeg_audio.parse(b"".join(frames))
        h = mpeg_audio.header(frames[0][:4])
        assert (len(s.offsets), s.checked, s.bad_crc, s.resyncs) == (6, 6, 0, 0), kind
        assert s.samples == 6 * h.samples and s.hz == h.hz
        hurt = bytearray(b"".join(frames))
        hurt[2 * h.size + 7] ^= 0x40
        d = mpeg_audio.parse(bytes(hurt))
        assert d.bad_crc == 1 and list(d.offsets) == [i * h.size for i in (0, 1, 3, 4, 5)] and d.samples == s.samples, kind


def test_tags_of_every_version():
    safe = mpeg_audio._to_synchsafe
    audio = b"".join(frame(random.Random(1), 3, 3, 9, 0, 3) for _ in range(3))

    def tag(major, flags, body, extra=b""):
        return bytes((*b"ID3", major, 0, flags)) + safe(len(body)) + body + extra

    text3 = lambda name, value, flags=b"\0\0": name + struct.pack(">I", len(value)) + flags + value
    text4 = lambda name, value, flags=b"\0\0": name + safe(len(value)) + flags + value
    cases = [
        (tag(2, 0, b"TT2" + (6).to_bytes(3, "big") + b"\0title"), {"TIT2": "title"}),
        (tag(3, 0x40, struct.pack(">IHI", 6, 0, 0) + text3(b"TIT2", b"\0title") + bytes(20)), {"TIT2": "title"}),
        (tag(3, 0x80, text3(b"TPE1", b"\1\xff\xfea\0b\0").replace(b"\xff", b"\xff\0")), {"TPE1": "ab"}),
        (tag(3, 0, text3(b"TALB", struct.pack(">I", 6) + zlib.compress(b"\0album"), b"\0\x80")), {"TALB": "album"}),
        (tag(4, 0x40, safe(6) + b"\x01\0" + text4(b"TIT2", b"\3t\xc3\xaftle")), {"TIT2": "tïtle"}),
        (tag(4, 0x10, text4(b"TXXX", b"\3key\0value"), b"3DI\4\0\x10" + safe(0)), {"key": "value"}),
        (tag(4, 0, text4(b"TIT2", safe(3) + b"\0\xff\0a", b"\0\x03")), {"TIT2": "ÿa"}),
    ]
    for data, want in cases:
        s = mpeg_audio.parse(data + audio)
        assert s.tags == want and len(s.offsets) == 3 and s.offsets[0] == len(data) and s.resyncs == 0, want
    old = b"TAG" + b"song".ljust(30, b"\0") + b"who".ljust(30) + b"where".ljust(30, b"\0") + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x11"
    assert mpeg_audio.parse(audio + old).tags == {"TIT2": "song", "TPE1": "who", "TALB": "where", "TYER": "1999", "COMM": "note", "TCON": "(17)", "TRCK": "7"}
    assert mpeg_audio.parse(b"no audio here").duration == 0


def test_tables_of_seek_places():
    h = bytes((0xFF, 0xFB, 0x90, 0xC0))
    size = mpeg_audio.header(h).size
    vbri = (h + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 9000, 20, 3, 2, 2, 7) + struct.pack(">HHH", 100, 200, 300)).ljust(size, b"\0")
    xing = (h + bytes(17) + b"Xing" + struct.pack(">III", 15, 20, 9000) + bytes(range(100)) + struct.pack(">I", 78)).ljust(size, b"\0")
    plain = h.ljust(size, b"\0")
    got = mpeg_audio.parse(vbri + plain * 2)
    assert got.table == {"kind": "VBRI", "bytes": 9000, "frames": 20, "frames_per_entry": 7, "toc": [200, 400, 600]} and len(got.offsets) == 2
    got = mpeg_audio.parse(xing + plain * 2)
    assert got.table["toc"] == list(range(100)) and got.table["quality"] == 78 and got.table["frames"] == 20
