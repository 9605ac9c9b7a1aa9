"""Tracks and places against plain walks over whole entities, and small cases with known results."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from vectrail.operators import tracks
from vectrail.sources import tables


def _bad(a, b):
    """Whether the trip from a to b is too fast."""
    h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
    km = 0 if a.camera_id == b.camera_id else 1.3 * 2 * 6371 * math.asin(min(1, math.sqrt(h)))
    return km > (90 if a.city == b.city == "home" else 130) * max((b.us - a.us) / 60e6 - a.dwell + 10, 0) / 60


def _plain_track(rows):
    """Every sighting in order against a linear scan of those accepted; no cutting into parts."""
    rank, kept, out = {"real": 0, "sim": 1}, [], {}
    for s in sorted(rows, key=lambda r: (rank.get(r.kind, 2), -(r.confidence or 0), r.us, r.sighting_id)):
        i = next((i for i, x in enumerate(kept) if x.us > s.us), len(kept))
        bad = next((o for o, a, b in ((kept[i - 1], kept[i - 1], s) if i else (None,) * 3, (kept[i], s, kept[i]) if i < len(kept) else (None,) * 3) if o and _bad(a, b)), None)
        out[s.sighting_id] = bad.sighting_id if bad else None
        if not bad:
            kept.insert(i, s)
    return out


def test_track_equals_plain_walk(spark, sf):
    located = tables.located(spark, sf)
    by = defaultdict(list)
    for r in located.withColumn("us", F.unix_micros("ts")).withColumn("dwell", F.coalesce("dwell_min", F.lit(0))).collect():
        by[r.entity_id].append(r)
    for reach in (tracks.reach_km(tables.cameras(spark)), 1e9):
        ours = {r.sighting_id: (r.accepted, r.conflict_with) for r in tracks.greedy_track(located, reach).collect()}
        theirs = {k: (v is None, v) for rows in by.values() for k, v in _plain_track(rows).items()}
        assert ours == theirs


def _frame(spark, rows):
    return spark.createDataFrame(rows, "sighting_id long, entity_id long, camera_id long, lat double, lon double, city string, ts string, kind string, confidence double, dwell_min long").withColumn("ts", F.to_timestamp("ts"))


def test_real_beats_simulated_and_edges(spark):
    rows = [
        (1, 1, 1, 55.5, 37.3, "home", "2024-01-01 10:00:00", "sim", 0.9, None), (2, 1, 2, 55.9, 37.3, "home", "2024-01-01 10:09:00", "real", None, None),
        (3, 1, 2, 55.9, 37.3, "home", "2024-01-01 10:09:00", "lookalike", 0.1, None), (4, 1, 1, 55.5, 37.3, "home", None, "real", 1.0, None),
    ]
    got = {r.sighting_id: (r.accepted, r.conflict_with) for r in tracks.greedy_track(_frame(spark, rows), 100.0).collect()}
    assert got == {1: (False, 2), 2: (True, None), 3: (True, None)}
    assert tracks.greedy_track(_frame(spark, []), 100.0).count() == 0


def _plain_places(points):
    """Every stay against all centres in order."""
    found, out = [], []
    for lat, lon in points:
        k = next((k for k, p in enumerate(found) if tracks._km(p[0], p[1], lat, lon) <= 0.3), len(found))
        n = found[k][2] if k < len(found) else 0
        found[k : k + 1] = [((found[k][0] * n + lat) / (n + 1), (found[k][1] * n + lon) / (n + 1), n + 1) if n else (lat, lon, 1)]
        out.append(k)
    return out


def test_places_by_cells_equal_a_scan():
    r = random.Random(4)
    for lat, lon, spread in ((55.7, 37.6, 0.02), (0.0, 180.0, 0.01), (89.99, 0.0, 0.05), (-33.0, -0.001, 0.005)):
        points = [(min(90.0, lat + r.uniform(-spread, spread)), lon + r.uniform(-spread, spread) * (300 if lat > 80 else 1)) for _ in range(1500)]
        points += [points[0]] * 3
        cells = tracks.Centres()
        assert [cells.join(*p) for p in points] == _plain_places(points)


def test_many_places_of_one_entity():
    cells, n = tracks.Centres(), 100_000
    assert [cells.join(40 + i // 400 * 0.01, 20 + i % 400 * 0.02) for i in range(n)] == list(range(n))
    assert cells.join(40.0001, 20.0) == 0


def test_roles(spark):
    rows = []
    for day in range(1, 6):  # Monday to Friday
        rows += [(day, 1, 1, 55.5, 37.3, "home", f"2024-01-0{day} 19:00:00", "sim", 0.5, 600), (10 + day, 1, 2, 55.7, 37.3, "home", f"2024-01-0{day} 06:00:00", "sim", 0.5, 540)]
    rows += [(20, 1, 3, 55.8, 37.6, "home", "2024-01-06 10:00:00", "sim", 0.5, 60), (21, 1, 4, 59.9, 30.3, "away", "2024-01-07 10:00:00", "sim", 0.5, 60), (22, 1, 4, 59.9, 30.3, "away", "2024-01-07 20:00:00", "sim", 0.5, 0)]
    got = {r.role: r for r in tracks.place_roles(_frame(spark, rows)).collect()}
    assert {k: (r.position, r.n_stays) for k, r in got.items()} == {"night": (1, 5), "day": (2, 5), "trip": (3, 1), "episodic": (4, 1)}
    assert got["night"].window == "22:00-08:00" and got["day"].window == "09:00-18:00"
    assert abs(got["night"].confidence - 0.6321206) < 1e-6 and got["trip"].confidence is None
