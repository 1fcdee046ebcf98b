"""Links and components against brute force over all pairs; the lattice; awkward rows."""

import numpy as np
import pytest

from prospectra.llm import lattice_dedup


def brute(rows):
    """n_links and component_id by row, in order."""
    unit = []
    for _, v, label in rows:
        x = None if label is None or not v or any(e is None or not np.isfinite(e) for e in v) else np.array(v, float)
        unit.append(None if x is None or not x.any() else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in links[k] if j not in seen and not seen.add(j)]
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def near(rng, x, cosine):
    z = rng.normal(size=len(x))
    x = x / np.linalg.norm(x)
    z -= (z @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(60):  # chains of links, and pairs just below the threshold
        x = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 6))):
            out.append((x * float(rng.uniform(0.1, 9))).tolist())
            x = near(rng, x, float(rng.choice([0.979, 0.981, 0.985, 0.999])))
    centre = rng.normal(size=64)
    out += [near(rng, centre, float(rng.uniform(0.985, 0.9999))).tolist() for _ in range(900)]  # more than a cell holds unsplit
    out += [out[3]] * 40 + [out[5]] * 3
    ids = rng.permutation(len(out)).tolist()
    made = [(int(i), v, int(rng.integers(2)) if k < 100 else 0) for k, (i, v) in enumerate(zip(ids, out))]
    return made


SCHEMA = "vec_id long, embedding array<double>, label int, n long, cell string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, lattice_dedup.near_vectors(df.repartition(5)).collect()), key=repr)


def test_links_equal_brute_force(spark, rows):
    got, want = found(spark, rows), brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(b[1] - a[1] for a, b in zip(got, want)) <= 0.0005 * sum(b[1] for b in want)  # of so many pairs just at the threshold a few are missed
    assert sum(a[2:] != b[2:] for a, b in zip(got, want)) <= 1


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 2.0], [2.0, 0.1, 4.0]
    rows = [
        (1, a, 0), (2, b, 0), (2, b, 0), (3, a, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [0.0, 0.0, 0.0], 0),
        (8, [1.0, None, 2.0], 0), (9, [1.0, float("nan"), 2.0], 0), (10, [1.0, float("inf"), 2.0], 0), (10, [1.0, float("inf"), 2.0], 0),
        (None, a, 0), (None, [0.0, 1.0, 0.0], 0), (None, [0.0, 1.0, 0.0], 0), (11, [1.0, 0.0, 2.0, 0.0], 0), (12, [1e300, 0.0, 2e300], 1), (13, [1e-300, 0.0, 2e-300], 1), (14, [3.0], 2), (15, [5.0], 2), (16, [-5.0], 2),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_decoder_finds_the_nearest_point():
    rng, steps = np.random.default_rng(1), lattice_dedup.roots()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    x = rng.normal(size=(500, 8)) * 3
    first, second = lattice_dedup.two_nearest(x, steps).transpose(1, 0, 2)
    away = lambda p: ((x - p) ** 2).sum(1)
    around = ((x[:, None] - first[:, None] - steps[None]) ** 2).sum(2)
    assert (away(first) <= around.min(1) + 1e-9).all()
    assert np.allclose(away(second), around.min(1))
    assert np.allclose(first.sum(1) % 2, 0) and (np.isclose(first % 1, 0).all(1) | np.isclose(first % 1, 0.5).all(1)).all()


@pytest.mark.parametrize("cosine", [0.98, 0.99])
def test_recall_of_the_cells(cosine):
    rng, label = np.random.default_rng(8), np.zeros(4000, np.int64)
    x = lattice_dedup.units(rng.normal(size=(4000, 64)))
    y = np.array([near(rng, v, cosine) for v in x])
    for most in (1000, 10**6):
        blocks, tables = lattice_dedup.shape(most)
        a, b = (lattice_dedup.cells(v, label, blocks, tables) for v in (x, y))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.998
