"""The forest search against all pairs."""

import math


import numpy as np
import pytest

from tidemark.llm import forest
from tidemark.llm import queries as Q
from tidemark.llm.forest import candidates, cosines, fit, leaves, margins, neighbours, units


def truth(ids, x, every, k):
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_op12_finds_nine_of_ten_and_scores_exactly(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    want, got = truth(ids, x, 50, 5), found(Q.op12_forest_search(spark, f"/root/testdata/sf{sf}"))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    at = {int(i): x[k].astype(np.float64) for k, i in enumerate(ids)}
    for q, v in got.items():
        for i, score in v:
            assert math.isclose(score, at[q] @ at[i] / np.linalg.norm(at[q]) / np.linalg.norm(at[i]), rel_tol=1e-12)
        assert v == sorted(v, key=lambda r: (-r[1], r[0]))


def test_cells_split_over_rounds_and_clusters_need_few_visits(spark, monkeypatch):
    """Small leaves and small trees, so that several rounds are needed; a third of the rows are copies of one vector."""
    monkeypatch.setattr(forest, "LEAF", 8)
    monkeypatch.setattr(forest, "SAMPLE", 64)
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 16))
    x = np.concatenate([centres[r.integers(0, 60, 1400)] + 0.1 * r.normal(size=(1400, 16)), np.repeat(centres[:1], 700, axis=0)]).astype(np.float32)
    ids = r.permutation(len(x))
    seen = []
    probes = forest.probes
    monkeypatch.setattr(forest, "probes", lambda *a, **k: seen.append(probes(*a, **k)) or seen[-1])
    grow = forest.grow
    monkeypatch.setattr(forest, "grow", lambda *a: seen.append(len((g := grow(*a))[0])) or g)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got, want = found(neighbours(df, every=20, k=5)), truth(ids, x, 20, 5)
    assert seen[0] >= 2
    copies = set(ids[1400:].tolist())
    clear = {q: w for q, w in want.items() if q not in copies}
    assert recall(got, clear) >= 0.9
    assert all(len(got[q]) == 5 and all(abs(s - 1) < 1e-12 for _, s in got[q]) for q in want if q in copies)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (None, [1.0, 0.1]), (9, [1e200, 1e200]), (10, [1e-200, 0.0]), (11, [1.0]), (12, [1.0, 2.0, 3.0]),
        (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.5]), (150, [1.0, 2.0, 3.0, 4.0]), (200, None),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<double>, rank int, `a.b` string")
    out = neighbours(df)
    got = found(out.filter("query_id <> 50"))
    assert set(got) == {0, 100}
    assert [v for v, _ in got[0]] == [1, 10, 50, 50, None]
    assert got[100] == [(11, 1.0)]
    assert sorted(r["vec_id"] for r in out.filter("query_id = 50 and rank <= 4").collect()) == [0, 0, 1, 1, 10, 10, 50, 50]
    assert neighbours(df.limit(0)).count() == 0


def test_leaves_and_margins_agree_and_copies_spread():
    r = np.random.default_rng(3)
    x = units(r.normal(size=(2000, 8)))
    tree = fit(x, 6, 1)
    at = leaves(tree, x, np.arange(2000), 9)
    assert np.bincount(at, minlength=64).min() > 10
    assert (margins(tree, x, np.full(2000, 1e9)).argmax(axis=1) == at).all()
    same = units(np.ones((4000, 8)))
    assert np.bincount(leaves(fit(same, 6, 1), same, np.arange(4000), 9), minlength=64).max() < 200
    assert len(np.unique(cosines(np.repeat(r.normal(size=(1, 33)), 50, axis=0), r.normal(size=33)))) == 1


def test_no_row_lies_on_a_cut():
    """An odd number of rows has its median in one of them; sums in another order would put that row on either side."""
    x = units(np.random.default_rng(5).normal(size=(1023, 8)))
    tree, parts = fit(x, 6, 1), {0: np.arange(len(x))}
    for node, row in enumerate(tree):
        own = parts.pop(node)
        far = x[own] @ row[:-1] - row[-1]
        assert row[:-1].any() and np.abs(far).min() > 1e-12
        parts[2 * node + 1], parts[2 * node + 2] = own[far > 0], own[far <= 0]


def test_candidates_hold_all_ties():
    x, q = np.array([[1.0, 0], [2.0, 0], [0, 1.0], [3.0, 0]]), np.array([5.0, 0])
    at, scores = candidates(x, q, np.array([True, False, False, False]), 1)
    assert at.tolist() == [1, 3] and scores.tolist() == [1.0, 1.0]
