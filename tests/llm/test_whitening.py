import math
from fractions import Fraction

import numpy as np
import pytest

from tidewire.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n string, component double, d int"


def rows_of(vectors):
    return [(i, v, "x", 0.5, 1) for i, v in vectors]


def brute(vectors, components, scale=64):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of vectors of one width, by the covariance in exact fractions."""
    good = [(i, [math.floor(np.float64(np.float32(c)) * scale) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    gap = lambda x: [n * a - s for a, s in zip(x, sums, strict=True)]
    gaps = [gap(x) for x in fit]
    cov = np.array([[float(Fraction(sum(g[a] * g[b] for g in gaps), n**3)) for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in good:
        g = gap(x)
        for k in range(min(d, components)):
            out[i, k + 1] = (n, sum(a * a for a in g), abs(np.dot(np.array(g, float) / n, axes[:, k])) / math.sqrt(values[k]), values[k] / cov.trace())
    return out


def vectors_of(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [[float(c) for c in v] for v in rng.normal(size=(n, d)) @ mix]


def test_whitening_equals_brute_force(spark):
    own = list(enumerate(vectors_of(400, 20)))
    own += [(1000 + i, own[3][1]) for i in range(300)]  # one vector holds much of the table and weighs once
    own += [(2000, None), (2001, [float("nan")] * 20), (2002, [*[1.0] * 19, None]), (2003, [*[1.0] * 19, float("-inf")]), (None, own[5][1]), (5, own[5][1])]
    wanted = brute([x for x in own if x[0] is not None], 16)
    got = whitening.whiten(spark.createDataFrame(rows_of(own), SCHEMA).repartition(7)).collect()
    assert len(got) == 16 * 702
    for r in got:
        n, deviation, size, explained = wanted[5 if r["vec_id"] is None else r["vec_id"], r["component"]]
        assert r["n"] == n and int(r["deviation"]) == deviation
        assert abs(abs(r["whitened"]) - size) < 1e-8 and abs(r["explained"] / explained - 1) < 1e-9
    assert {r["identity_error"] for r in got} != {None} and max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    signs = {r["component"]: np.sign(r["whitened"]) for r in got if r["vec_id"] == 0}
    same = {r["component"]: np.sign(r["whitened"]) for r in got if r["vec_id"] == 1000}
    third = {r["component"]: np.sign(r["whitened"]) for r in got if r["vec_id"] == 3}
    assert same == third and signs


def test_whitening_on_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows_of([(1, None), (2, []), (3, [None])]), SCHEMA)).count() == 0
    alone = whitening.whiten(spark.createDataFrame(rows_of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), SCHEMA)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, 0.0, None)] * 4
    # two widths are two spaces; a constant dimension has no whitened value; large entries stay exact
    mixed = [(i, [float(i % 5), 7.0]) for i in range(10)] + [(100 + i, [float(i), float(i * i % 7), float(i % 3)]) for i in range(10)] + [(200, [2.0**50, 0.0, 1.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows_of(mixed), SCHEMA)).collect()}
    assert len(got) == 2 * 10 + 3 * 11
    assert all(got[i, 1]["n"] == 5 and got[i, 2]["whitened"] is None and got[i, 1]["whitened"] is not None for i in range(10))
    grid = [[math.floor(64 * c) for c in v] for i, v in mixed if i >= 100]
    sums = [sum(c) for c in zip(*grid, strict=True)]
    assert int(got[200, 1]["deviation"]) == sum((11 * c - s) ** 2 for c, s in zip(grid[-1], sums, strict=True))


@pytest.mark.parametrize("cuts", [[30], [1, 2, 3], [50, 51, 100]])
def test_merged_summaries_lose_nothing(cuts):
    x = np.floor(np.array(vectors_of(130, 24, 3)) * 64).astype(np.int64)
    merged = None
    for part in np.split(x, cuts):
        own = whitening.Summary.of(part)
        merged = own if merged is None else merged.merge(own)
    whole = whitening.Summary.of(x)
    assert merged.n == 130 and list(merged.sums) == list(whole.sums) and len(merged.s) == 24
    assert np.allclose(merged.s, np.linalg.svd(x - x.mean(0), compute_uv=False), rtol=1e-12)


def test_many_summaries_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    own = list(enumerate(vectors_of(90, 6, 5)))
    wanted = brute(own, 16)
    got = whitening.whiten(spark.createDataFrame(rows_of(own), SCHEMA)).collect()
    assert len(got) == len(wanted) and all(abs(abs(r["whitened"]) - wanted[r["vec_id"], r["component"]][2]) < 1e-9 for r in got)
