"""Epsilon grid order join against all pairs."""

import numpy as np
import pytest

from waymark.llm import vectorlinks

SCHEMA = "vec_id long, embedding array<float>, label int, no long"


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id) of every row with an id."""
    rows = [(r[0], r[1]) for r in rows if r[0] is not None]
    width = max((len(v) for _, v in rows if v is not None), default=0)
    fine = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(fine), width))
    for k, i in enumerate(fine):
        x[k, : len(rows[i][1])] = np.array(rows[i][1], np.float32)
    s = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    near = s >= least
    np.fill_diagonal(near, False)
    label = np.array([rows[i][0] for i in fine])
    while len(fine):
        new = np.minimum(label, np.where(near, label[None, :], 2**62).min(axis=1, initial=2**62))
        if (new == label).all():
            break
        label = new
    out = {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(fine)}
    return sorted((rows[i][0], *out.get(i, (0, rows[i][0]))) for i in range(len(rows)))


def clustered(seed, n=1500, width=24, spread=0.06):
    """Clusters, copies, scaled copies, chains of near vectors, and vectors that take no part."""
    g = np.random.default_rng(seed)
    centers = g.normal(size=(12, width))
    x = centers[g.integers(0, 12, n)] + spread * g.normal(size=(n, width)) * g.choice([1, 1, 6], n)[:, None]
    x[:200] = x[0]  # exact copies
    x[200:220] = x[1] * np.linspace(0.1, 1000, 20)[:, None]
    angle = np.arange(40) * 0.3  # a chain: neighbours link, ends don't
    x[220:260] = 0
    x[220:260, 0], x[220:260, 1] = np.cos(angle), np.sin(angle)
    rows = [(int(i), [float(y) for y in np.float32(v)]) for i, v in zip(g.permutation(n) * 3, x)]
    rows += [(9001, None), (9002, [0.0] * width), (9003, [float("nan")] + [1.0] * (width - 1)), (9004, [None] + [1.0] * (width - 1)), (9005, []), (9006, [float("inf")] * width)]
    rows += [(9007, rows[5][1][:10]), (9008, rows[5][1][:10] + [0.0] * (width - 10)), (9007, rows[8][1]), (None, rows[8][1])]
    rows += [(9100, [9.0, 3.0, 3.0, 1.0]), (9101, [1.0]), (9102, [1e-30]), (9103, [3e30])]  # a cosine of just 0.9
    return [(i, v, 1, i) for i, v in rows]


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = clustered(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(vectorlinks.near_links(df)) == brute(rows)
    assert max(r[1] for r in brute(rows)) > 200


@pytest.mark.parametrize("least", [0.9, 0.99, 0.5, 0.0])
def test_levels(spark, monkeypatch, least):
    """Small blocks, so that pairs of intervals are descended and settled on several levels."""
    for name, value in (("BLOCK", 8), ("LEAF", 3), ("FAN", 2), ("SIDE", 2), ("TOP", 2)):
        monkeypatch.setattr(vectorlinks, name, value)
    rows = clustered(7, 500, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(vectorlinks.near_links(df, least)) == brute(rows, least)


def test_doubles_and_large_components(spark):
    rows = [(i, v) for i, v in enumerate([[1e200, 1e200], [1e200, 1.1e200], [1e-200, 1e-200], [-1e200, 0.0], [5e-324, 5e-324]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(vectorlinks.near_links(df)) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 0, 3), (4, 3, 0)]


def test_empty_tables(spark):
    assert vectorlinks.near_links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(vectorlinks.near_links(spark.createDataFrame([(4, None, 1, 1), (None, [1.0], 1, 1)], SCHEMA))) == [(4, 0, 4)]


def test_distant_blocks_are_skipped():
    """Clusters far apart are not multiplied with each other."""
    g = np.random.default_rng(3)
    x = np.repeat(g.normal(size=(8, 32)), 512, axis=0) + 0.02 * g.normal(size=(4096, 32))
    basis = vectorlinks._directions(list(x[::8]), 32)
    eps = np.sqrt(0.2)
    p = vectorlinks.unit_rows(x)[1] @ basis
    order = np.lexsort((*p.T[::-1], *np.floor(p / eps).T[::-1]))
    tile = vectorlinks.Tile({0: x[order[:2048]], 1: x[order[2048:]]}, basis, 0.9)
    for a, b in ((0, 0), (0, 1), (1, 1)):
        tile.join(a, b)
    assert tile.links.sum() == 8 * 512 * 511
    assert tile.compared < 0.3 * 4096 * 4097 / 2
