"""Comparable sales in tiles: crowded places, several passes, ties, repeated keys."""

from __future__ import annotations

import datetime as dt
import random
from datetime import date as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import spatial
from tests.test_round3 import joined_rows

SALES = "sale_id long, sale_date date, latitude double, longitude double, sales_price double, gross_sqft double, as_of_date date, bbl long, comp_segment string"


def sales_of(rng, n, place, segments=("x",)):
    d0 = D(2020, 1, 1)
    out = []
    for i in range(n):
        d, (la, lo) = d0 + dt.timedelta(days=rng.randint(0, 1500)), place(rng)
        out.append((i, d, la, lo, float(rng.choice([50_000, 200_000 + rng.randint(0, 500_000)])), rng.choice([None, 50.0, 900.0]), d - dt.timedelta(days=1), rng.randint(0, n // 2), rng.choice(segments)))
    return out


def test_a_crowded_place_is_not_joined_pair_by_pair(spark):
    """3 000 sales of a year at one place: 5 comps each by range, no pair of them is joined."""
    rng = random.Random(4)
    rows = [(i, d, 40.7, -73.9, 200_000.0 + i, 900.0, d - dt.timedelta(days=1), i, "x") for i, d in ((i, D(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 300))) for i in range(3000))]
    made = spatial.knn_temporal_comps(spark.createDataFrame(rows, SALES))
    got = {r.bbl: r for r in made.collect()}
    assert max(joined_rows(made)) <= 3000
    by_id = sorted(rows)
    for i, _, _, _, _, _, day, *_ in rng.sample(rows, 300):
        want = [r for r in by_id if 1 <= (day - r[1]).days <= 365][:5]
        assert (i in got) == bool(want)
        if want:
            assert got[i].comp_count == len(want) and got[i].comp_search_dist_km == 0
            assert got[i].comp_median_price == pytest.approx(np.median([r[4] for r in want]))
            assert got[i].comp_recency_days == min((day - r[1]).days for r in want)


@pytest.mark.parametrize("tile_rows", [60, 200_000])
def test_tiles_give_what_the_join_gives(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(spatial, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(spatial, "PAIR_ROWS", 500 if tile_rows == 60 else spatial.PAIR_ROWS)

    def place(rng):  # a tower, a lattice with equal distances, the country
        p = rng.random()
        return (40.7, -73.9) if p < 0.3 else (40.7 + rng.randint(-8, 8) / 256, -73.9 + rng.randint(-8, 8) / 256) if p < 0.8 else (rng.uniform(40.2, 41.2), rng.uniform(-74.4, -73.4))

    rows = sales_of(random.Random(tile_rows), 1500, place, ("x", "y", None))
    df = spark.createDataFrame(rows + rows[:40] + [(None, D(2021, 5, 5), None, -73.9, 3e5, 1.0, None, None, "x")], SALES)
    key = ["sale_id", "bbl", "as_of_date", "comp_segment"]  # equal keys have one place: both plans take that
    tiles, join = ([tuple(r) for r in spatial.knn_temporal_comps(df, key=key, dense=d).select(*key, "comp_count", F.round("comp_median_price", 6), F.round("comp_median_ppsqft", 6),
                   "comp_search_dist_km", "comp_recency_days", F.round("comp_p25_price", 6), F.round("comp_p75_price", 6)).collect()] for d in (0, 10**9))
    assert len(tiles) > 500 and sorted(tiles, key=str) == sorted(join, key=str)
