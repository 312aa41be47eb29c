"""The search of one block, without a session."""

import numpy as np
import pandas as pd
import pytest

from pricelens.operators import retrieve


def codes(values, name):
    unit = np.abs(values).max(axis=1) / 32767
    code = np.rint(values / np.where(unit > 0, unit, 1.0)[:, None])
    lost = np.sqrt(((values - code * unit[:, None]) ** 2).sum(axis=1))
    return pd.DataFrame({name: np.arange(len(values)), "code": [c.tobytes() for c in code.astype("<i2")], "unit": unit, "lost": lost})


@pytest.mark.parametrize("kind", ["spread", "unit", "equal"])
@pytest.mark.parametrize("k", [1, 5, 700])
def test_no_neighbour_is_missed(kind, k, monkeypatch):
    monkeypatch.setattr(retrieve, "TILE_ROWS", 64)
    monkeypatch.setattr(retrieve, "TILE_QUERIES", 16)
    rng = np.random.default_rng(5)
    rows, asked = rng.standard_normal((600, 8)), rng.standard_normal((90, 8))
    if kind == "spread":
        rows, asked = rows * rng.exponential(50, (600, 1)), asked * rng.exponential(50, (90, 1))
    if kind == "equal":
        rows[:300] = asked[:40] = rows[0]
    found = retrieve._bounded_search(k)(codes(asked, "rep"), codes(rows, "id"))
    d = ((asked[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    last = np.sort(d, axis=1)[:, min(k, 600) - 1]
    held = set(zip(found["rep"].astype(int), found["id"].astype(int)))
    assert {(q, i) for q, i in zip(*np.nonzero(d <= last[:, None]))} <= held
    assert (found["low"] <= d[found["rep"].astype(int), found["id"].astype(int)] + 1e-6).all()


def test_rows_of_far_lengths_are_not_compared(monkeypatch):
    """Texts of very different lengths: a query looks at a small part of the block."""
    rng, seen, points = np.random.default_rng(6), [], retrieve._Block.points
    values = rng.exponential(100, (20_000, 1)) * (1 + 0.05 * rng.standard_normal((20_000, 6)))
    monkeypatch.setattr(retrieve, "TILE_ROWS", 500)
    monkeypatch.setattr(retrieve._Block, "points", lambda self, at, to: seen.append(to - at) or points(self, at, to))
    retrieve._bounded_search(5)(codes(values[:5_000], "rep"), codes(values, "id"))
    assert sum(seen) < 0.3 * 20 * 20_000


def test_what_is_no_point_is_near_nothing():
    rows = codes(np.eye(4), "id")
    rows.loc[2, ["unit", "lost"]] = np.nan
    found = retrieve._bounded_search(2)(codes(np.eye(4)[:1], "rep"), rows)
    assert set(found["id"].astype(int)) == {0, 1, 3}
    assert retrieve._bounded_search(2)(codes(np.eye(4), "rep"), rows.iloc[2:3]).empty
