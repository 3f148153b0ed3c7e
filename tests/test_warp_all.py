"""Tracks laid on a mean together take the paths that each takes alone."""

import numpy as np

from waymeet.operators.barycentre import warp, warp_all


def test_together_as_alone():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 6), (7, 1), (5, 9), (9, 5)):
        tracks, mean = rng.integers(0, 4, (20, n, 3)).astype(float), rng.integers(0, 4, (m, 3)).astype(float)
        costs, steps = warp_all(tracks, mean)
        for b in range(20):
            path = [(int(i[who == b][0]), int(j[who == b][0])) for who, i, j in steps if (who == b).any()][::-1]
            cost, rows, places = warp(tracks[b], mean)
            assert np.isclose(cost, costs[b]) and path == list(zip(rows.tolist(), places.tolist(), strict=True))
