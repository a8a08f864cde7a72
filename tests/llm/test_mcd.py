"""The robust estimate against a search of all subsets, and its verdicts on odd tables."""

import itertools
import random

import numpy as np

from sheetspark.llm import quality_mcd as mcd

DOCS = "doc_id long, text string, lang string, source string, g string, x0 string, n long"
TINY = (1e-6,) * mcd.P


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "g", "x", 1) for i, t, lang, s in rows], DOCS)


VOCABULARY = random.Random(1).choices(["".join(random.Random(i).choices("abcdefghij", k=2 + i % 7)) for i in range(400)], k=400)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def points(seed, n, far):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(mcd.P, mcd.P))
    x = rng.normal(size=(n, mcd.P)) @ mix + 3
    x[:far] += 25
    return x


def estimates(spark, tables, **options):
    """group -> rows behind the estimate, centre and scatter."""
    rows = [(g, *map(float, r)) for g, x in tables.items() for r in x]
    out = {}
    for r in mcd.estimate(spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in mcd.X)), **options).collect():
        inverse = np.zeros((mcd.P, mcd.P))
        for i, j in mcd.PAIRS:
            inverse[i, j] = inverse[j, i] = r[f"p{i}{j}"]
        out[r.g] = r.n, np.array([r[f"m{i}"] for i in range(mcd.P)]), np.linalg.inv(inverse)
    return out


def best_subset(x, h):
    return min(itertools.combinations(range(len(x)), h), key=lambda s: np.linalg.slogdet(np.cov(x[list(s)].T, bias=True))[1])


HALF = mcd.CHI_CORE / 2
FACTOR = mcd.CORE / (1 - np.exp(-HALF) * (1 + HALF + HALF * HALF / 2))


def test_estimate_is_the_best_of_all_subsets(spark):
    tables = {f"{seed}": points(seed, n, far) for seed, n, far in ((1, 16, 3), (2, 16, 4), (3, 18, 4), (4, 17, 0))}
    got = estimates(spark, tables, ridge=TINY, subsets=60, best_of=12, reweighted=False)
    for g, x in tables.items():
        best = list(best_subset(x, -(-3 * len(x) // 4)))
        n, centre, scatter = got[g]
        assert n == len(best) and np.allclose(centre, x[best].mean(0), rtol=1e-6), g
        assert np.allclose(scatter, np.cov(x[best].T, bias=True) * FACTOR, rtol=1e-3, atol=1e-4), g


def test_few_starts_come_near(spark):
    """The starts that the operator takes: the far rows are out, and the determinant is near the least one."""
    tables = {str(seed): points(seed, 16, 3) for seed in range(8)}
    for g, (_, centre, scatter) in estimates(spark, tables, ridge=TINY, reweighted=False).items():
        x = tables[g]
        least = np.linalg.slogdet(np.cov(x[list(best_subset(x, 12))].T, bias=True) * FACTOR)[1]
        assert np.abs(centre - 3).max() < 4 and np.linalg.slogdet(scatter)[1] - least < 1.2


def test_groups_have_estimates_of_their_own(spark):
    rng = np.random.default_rng(7)
    ordinary = np.array([0.03, 0.13, 0.16, 0.45])
    got = estimates(spark, {g: rng.normal(size=(400, mcd.P)) * wide * ordinary + 1 for g, wide in (("a", 1.0), ("b", 4.0))})
    a, b = (np.sqrt(np.diag(got[g][2])) for g in "ab")
    # the scales are estimated: near the true ones, several ridges wide, and apart from group to group
    assert np.allclose(a, ordinary, rtol=0.25) and np.allclose(b, 4 * ordinary, rtol=0.25)
    assert (b > 3 * a).all() and (a > 2 * np.array(mcd.RIDGE)).all()


def test_limit_is_the_quantile():
    rng = np.random.default_rng(5)
    # Hotelling: squared distance of a new row from the mean and scatter of n others
    far = []
    for _ in range(20_000):
        x = rng.normal(size=(30, mcd.P))
        m, s = x.mean(0), np.cov(x.T)
        d = rng.normal(size=mcd.P) - m
        far.append(d @ np.linalg.solve(s, d))
    assert abs(np.mean(np.array(far) > mcd._f_limit(30, 0.01)) - 0.01) < 0.003
    assert abs(mcd._f_limit(1e7, 1e-6) - 33.376844) < 1e-3


def test_odd_tables(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, int(60 * 1.5 ** (i % 10))), "en", "ab"[i % 2]) for i in range(120)]
    rows += [(200, prose(rng, 60_000), "en", "a"), (201, None, None, None), (202, "", "en", "a"), (203, prose(rng, 80), "rare", "a"), (204, "### $$$ %%% " * 30 + prose(rng, 200), "en", "a"), (205, " ".join(w + "###$$$%%%" for w in prose(rng, 90).split()), None, "z"), (206, prose(rng, 100), "en", None)]
    rows += [(207, rows[0][1], "en", "a")] * 60
    rows.append((None, prose(rng, 120), "en", "b"))
    found = mcd.judge(docs(spark, rows)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all(got[i].kept for i in (*range(120), 200, 203, 206, 207, None)) and got[200].n_words == 60_000
    assert not got[201].kept and not got[202].kept and got[201].base_failed and got[202].n_words == 0
    assert not got[204].kept and not got[205].kept and not got[205].base_failed
    few = mcd.judge(docs(spark, rows[:20])).collect()
    assert all(r.kept and r.distance is None for r in few)
    assert mcd.judge(docs(spark, []).limit(0)).count() == 0


def test_mere_copies_reject_nothing_else(spark):
    rng = random.Random(4)
    same = prose(rng, 150)
    rows = [(i, same, "en", "a") for i in range(200)] + [(1000 + i, prose(rng, int(60 * 1.5 ** (i % 8))), "en", "a") for i in range(60)]
    assert all(r.kept for r in mcd.judge(docs(spark, rows)).collect())


def test_texture():
    assert mcd.texture("") == (0, 0, 0) and mcd.texture("a_b, c!\n1") == (3, 3, 3)
    words = [str(i % 30) for i in range(120)]
    assert mcd.texture(" ".join(words)) == (0, 60, 100)
