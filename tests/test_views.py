"""Matches and suppression within a frame against passes in order, on dense fields."""

import numpy as np
import pyarrow as pa
import pytest

from nightframe.operators import views

rng = np.random.default_rng(5)


def field(n, line):
    """Points on a grid of tenths, so that distances tie; on a line they are many to a pixel."""
    return np.round(rng.uniform(0, 30, n), 1), np.round(rng.uniform(0, 0.4 if line else 30, n), 1)


def passed(pairs):
    a, b, out = set(), set(), []
    for *_, i, j in sorted(pairs):
        if i not in a and j not in b:
            a.add(i), b.add(j)
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("line", [False, True])
def test_matches(line, monkeypatch):
    monkeypatch.setattr(views, "CHUNK", 50)
    for _ in range(5):
        (x, y), (u, v) = field(200, line), field(170, line)
        d2 = lambda i, j: (x[i] - u[j]) ** 2 + (y[i] - v[j]) ** 2  # noqa: B023, E731
        every = [(d2(i, j), i, j) for i in range(200) for j in range(170) if d2(i, j) <= 9.0]
        i, j, d = views.near_pairs(x, y, u, v, 3.0)
        assert sorted(zip(d, i, j, strict=True)) == sorted(every)
        i, j, _ = views.nearest_first(x, y, u, v, np.arange(200), np.arange(170), 3.0)
        assert sorted(zip(i, j, strict=True)) == passed((d, i, j, i, j) for d, i, j in every)
        i, j = views.in_turn(x, y, u, v, np.arange(170), 3.0)
        assert sorted(zip(i, j, strict=True)) == passed((i, d, j, i, j) for d, i, j in every)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("line", [False, True])
def test_spaced(line, inclusive):
    x, y = field(400, line)
    want = []
    for i in range(400):
        near = lambda k: (x[i] - x[k]) ** 2 + (y[i] - y[k]) ** 2  # noqa: B023, E731
        if not any(near(k) <= 4.0 if inclusive else near(k) < 4.0 for k in want):
            want.append(i)
    assert views.spaced(x, y, 2.0, inclusive, head=30).tolist() == want


def test_dense_matches_do_not_pair_all():
    """100 points to a pixel: 20 million pairs within 3 pixels, which a match must not make."""
    x = np.sort(rng.uniform(0, 300, 30000))
    zero, ids = np.zeros(30000), np.arange(30000)
    made, near = [0], views.near_pairs

    def counted(*args):
        out = near(*args)
        made[0] += len(out[0])
        return out

    views.near_pairs = counted
    try:
        i, j, _ = views.nearest_first(x, zero, x + 0.001, zero, ids, ids, 3.0)
        turn = views.in_turn(x, zero, x + 0.001, zero, ids, 3.0)
    finally:
        views.near_pairs = near
    assert len(i) > 29000 and len(turn[0]) > 29000
    assert made[0] < 5_000_000


def test_pairs_that_are_decided_at_once_are_few():
    """Detections beside a dense line are nearest to many stars at once, all about as far."""
    n = 3000
    x, zero, ids, made, lexsort = np.sort(rng.uniform(0, 30, n)), np.zeros(n), np.arange(n), [], np.lexsort

    def counted(keys):
        made.append(len(keys[0]))
        return lexsort(keys)

    np.lexsort = counted
    try:
        i, j, d2 = views.nearest_first(x, zero, x, zero + 0.5, ids, ids, 3.0)
    finally:
        np.lexsort = lexsort
    assert max(made) < 5 * n
    every = [((x[a] - x[b]) ** 2 + 0.25, a, b, a, b) for a in range(n) for b in range(n) if abs(x[a] - x[b]) < 0.1]
    same = dict(zip(i.tolist(), j.tolist(), strict=True))
    close = passed(every)
    assert sum(same[a] == b for a, b in close) == len(close) and len(close) > n / 2
    assert len(i) == n


def test_descriptors():
    """Clusters, equal places and lone points, against all pairs."""
    x, y = (np.concatenate([rng.uniform(0, 700, 40), c + rng.normal(0, 0.01, 60), [c, c]]) for c in (300.0, 200.0))
    a, b = (x - 370) / 1900, (288 - y) / 1900
    u = np.stack([a, b, np.ones(len(a))]) / np.sqrt(a * a + b * b + 1)
    v = views.View(0, 1900.0, 740.0, 576.0, {"x": x, "y": y}, tuple(u), tuple(u), np.arange(len(x)))
    angle = np.arccos(np.clip(sum(c[:, None] * c for c in u), -1, 1))
    np.fill_diagonal(angle, np.inf)
    d = views.least_angles(v, 5)
    assert np.array_equal(d, np.sort(angle, axis=1)[:, :5])
    j, far = views.most_alike(d + 1e-5, d, np.arange(len(x)), 3)
    every = sum(np.abs(d[:, c][:, None] + 1e-5 - d[:, c]) for c in range(5)) / 5
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), every.shape), every), axis=-1)[:, :3]
    assert np.array_equal(j, want)
    assert np.array_equal(far, np.take_along_axis(every, want, 1))


def test_chosen_stars():
    """Views that leave stars out have all that may lie near their pixels, or the brightest."""
    n, m = 5000, 3
    u = rng.normal(size=(n, 3)) * [0.3, 0.3, 0.05] + [0, 0, 1]
    u /= np.linalg.norm(u, axis=1)[:, None]
    star, mag = np.arange(n), np.round(rng.uniform(0, 6, n), 1)
    px, py = rng.uniform(0, 740, 20), rng.uniform(0, 576, 20)
    rows = {"star_id": np.append(star, np.arange(m)), "mag": np.append(mag, np.zeros(m))} | {f"u{c}": np.append(u[:, i], np.zeros(m)) for i, c in enumerate("xyz")}
    rows |= {"view": [None] * n + [[1.0, 0, 0, 0, 1, 0, 0, 0, 1, f, 740, 576] for f in (1900, 1500, 2500)], "own": [None] * n + [{"px": px.tolist(), "py": py.tolist()}] * m}
    shown = lambda choice: [v.seen() for v in views._views(pa.table(rows), ["star_id", "mag"], 0.9, choice)]
    every = shown(views.Choice())
    near = shown(views.Choice(near=lambda own: (np.array(own["px"]), np.array(own["py"]), 7.4)))
    bright = shown(views.Choice("mag", lambda v: len(v.seen().place) >= 30))
    for a, b, c in zip(every, near, bright, strict=True):
        pairs = lambda v: sorted((v.star["star_id"][j], i) for i, j in zip(*views.near_pairs(px, py, v.star["x"], v.star["y"], 7.4)[:2], strict=True))
        assert pairs(a) == pairs(b) and len(b.place) < len(a.place)
        limit = c.star["mag"].max()
        assert 30 <= len(c.place) < len(a.place)
        assert sorted(c.star["star_id"]) == sorted(a.star["star_id"][a.star["mag"] <= limit])


@pytest.mark.parametrize("kind", ["plane", "line", "lattice", "one place", "one far", "apart"])
def test_total_of_pairs(kind):
    """As of all pairs, at the radius itself, too."""
    rng = np.random.default_rng(22)
    x, y, u, v = rng.random((4, 4000)) * 25 - 5
    if kind == "line":
        y, v = 2 * x, 2 * u + 0.2 * rng.integers(-5, 6, len(u))
    elif kind == "lattice":
        x, y, u, v = np.round([x, y, u, v])
    elif kind == "one place":
        x, y, u, v = np.full((4, 3000), 5.0)
    elif kind == "one far":
        x[0], v[0], u[1] = 1e5, -1e5, -3e5
    elif kind == "apart":
        u += 1000
    d2 = np.concatenate([d2 for _, _, d2 in views.near_chunks(x, y, u, v, 3.0)])
    n, total = views.near_total(x, y, u, v, 3.0)
    assert n == len(d2)
    assert total == pytest.approx(d2.sum(), rel=1e-9)


def test_total_of_dense_pairs_makes_few(monkeypatch):
    rng = np.random.default_rng(23)
    x = np.sort(rng.random(60000)) * 700
    made, chunks = [0], views.near_chunks

    def counted(*args):
        for i, j, d2 in chunks(*args):
            made[0] += len(i)
            yield i, j, d2

    monkeypatch.setattr(views, "near_chunks", counted)
    sizes, repeat = [], np.repeat
    monkeypatch.setattr(views.np, "repeat", lambda a, n, *more: sizes.append(len(out := repeat(a, n, *more))) or out)
    n, _ = views.near_total(x, x / 2, x + 0.2, x / 2, 3.0)
    assert n > 20_000_000
    assert made[0] == 0 and sum(sizes) < n / 2
