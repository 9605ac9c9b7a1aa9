"""Tracks of entities through cameras, and the places where they stay.

Both walks depend on their order, so rows are shuffled by group, sorted within partitions and walked in Arrow batches, many
groups to a batch and one state at a time. Tracks are cut at gaps so long that any trip fits in them: no conflict crosses such
a gap, so the parts give the same result as the whole, and parts of one sighting are accepted without a walk.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import places

TRACK = "sighting_id long, entity_id long, accepted boolean, conflict_with long, km double, gap_min double, need_kmh double"
#: Stays within this distance of a place's centre belong to it; covered dates that make a place regular.
PLACE_KM, REGULAR = 0.3, 4
#: Local hours that a stay must contain to count as a night and as a working day.
NIGHT_HOUR, DAY_HOUR = 3, 13


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    x = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * places.RADIUS_KM * math.asin(math.sqrt(min(x, 1.0)))


#: Columns of a sighting in the walk, after its group, and those that the walk passes on.
SIGHT = ("us", "sighting_id", "camera_id", "lat", "lon", "city", "dwell")
PASSED = "us long, camera_id long, lat double, lon double, city string, dwell double, rank int"


def _hindrance(first: tuple, second: tuple) -> tuple[float, float, float] | None:
    """km, minutes and needed speed of a trip that doesn't fit between two sightings; None if it fits."""
    us1, _, camera1, lat1, lon1, city1, dwell = first
    us2, _, camera2, lat2, lon2, city2, _ = second
    if camera1 == camera2:
        km = 0.0
    else:
        km = places.ROAD_FACTOR * _km(lat1, lon1, lat2, lon2)
    minutes = (us2 - us1) / 60e6 - dwell
    top = places.HOME_KMH if city1 == city2 == "home" else places.OPEN_KMH
    if 60 * km > top * max(minutes + places.GRACE_MIN, 0.0):
        return km, minutes, 60 * km / max(minutes, 0.5)
    return None


def decision(line: list[tuple], sight: tuple) -> tuple:
    """(accepted, conflict_with, km, gap_min, need_kmh) of the next sighting; ``line``, the accepted ones in time order, takes it if it fits."""
    at = bisect_right(line, sight[0], key=lambda s: s[0])
    found = None
    for one, two, other in ((at - 1, None, at - 1), (None, at, at)):
        if found is None and 0 <= other < len(line):
            trip = _hindrance(line[one] if one is not None else sight, line[two] if two is not None else sight)
            found = trip and (line[other][1], *trip)
    if found is None:
        line.insert(at, sight)
    return found is None, *(found or (None,) * 4)


def decided(part: list[tuple]) -> Iterator[tuple[int, tuple]]:
    """(sighting_id, decision) of a part's sightings (rank, trust, and SIGHT), which come in order of trust."""
    line: list[tuple] = []
    for s in part:
        yield s[3], decision(line, s[2:])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sightings sorted by group and, within it, by trust; state: the group's accepted ones in time order."""
    names, passed = ([c.split()[0] for c in x.split(", ")] for x in (TRACK, PASSED))
    group, line = None, []
    for batch in batches:
        out = []
        for entity, part, *sight in zip(*(batch.column(c).to_pylist() for c in ("entity_id", "part", *SIGHT)), strict=True):
            if (entity, part) != group:
                group, line = (entity, part), []
            out.append((sight[1], entity, *decision(line, tuple(sight))))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 3)
        found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*found, *(batch.column(c) for c in passed)], names=[*names, *passed])


def reach_km(cameras: DataFrame) -> float:
    """Upper bound of the road distance between two cameras of the registry (one row of four numbers reaches the driver)."""
    r = cameras.agg(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"), F.min(F.abs("lat"))).first()
    if r[0] is None:
        return 0.0
    return places.ROAD_FACTOR * places.RADIUS_KM * (math.radians(r[0]) + math.radians(r[1]) * math.cos(math.radians(r[2])))


def walk_rows(located: DataFrame) -> DataFrame:
    """What the walk needs of sightings; those without id, entity, time or position drop out."""
    return located.dropna(subset=["sighting_id", "entity_id", "ts", "lat", "lon"]).select(
        "sighting_id", "entity_id", "camera_id", "lat", "lon", "city", F.unix_micros("ts").alias("us"), F.coalesce("dwell_min", F.lit(0)).cast("double").alias("dwell"),
        F.when(F.col("kind") == "real", 0).when(F.col("kind") == "sim", 1).otherwise(2).alias("rank"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("trust"),
    )


def greedy_track(located: DataFrame, reach: float) -> DataFrame:
    """The decisions of ``walked``, as TRACK."""
    return walked(located, reach).select(*[c.split()[0] for c in TRACK.split(", ")])


def walked(located: DataFrame, reach: float) -> DataFrame:
    """Accept sightings from the most reliable on, if the trips from and to their neighbours in time are feasible.

    Order: real, simulated, look-alike; then confidence (null: 0) downwards, time, id. A rejected one names the neighbour that
    it conflicts with, the earlier first. Null times or positions drop out. Rows are TRACK and what the walk has of the sighting.
    """
    d = walk_rows(located)
    by_time = Window.partitionBy("entity_id").orderBy("us", "sighting_id")
    ended = F.max(F.col("us") + F.col("dwell") * 60e6).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    enough = reach / min(places.HOME_KMH, places.OPEN_KMH) * 60 * 60e6
    d = d.withColumn("cut", F.coalesce((F.col("us") - ended > enough).cast("int"), F.lit(0))).withColumn("part", F.sum("cut").over(by_time))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("entity_id", "part")))
    passed = [c.split()[0] for c in PASSED.split(", ")]
    alone = d.where("n = 1").selectExpr("sighting_id", "entity_id", "true AS accepted", *(f"cast(NULL AS {t}) AS {c}" for c, t in (x.split() for x in TRACK.split(", ")[3:])), *passed)
    # more parts per partition than entities: a busy entity's parts are dealt over many tasks
    rest = d.where("n > 1").repartition("entity_id", "part").sortWithinPartitions("entity_id", "part", "rank", F.desc("trust"), "us", "sighting_id")
    return alone.union(rest.select("entity_id", "part", "sighting_id", *passed).mapInArrow(_walk, f"{TRACK}, {PASSED}"))


def accepted_sightings(track: DataFrame) -> DataFrame:
    """The accepted sightings of ``walked`` as ``place_roles`` takes them, with ``real``."""
    return track.where("accepted").select("sighting_id", "entity_id", "lat", "lon", "city", F.timestamp_micros("us").alias("ts"), F.col("dwell").alias("dwell_min"), (F.col("rank") == 0).alias("real"))


class Centres:
    """An entity's places by running centre, in a grid of cells of PLACE_KM around the earth.

    A straight line is shorter than the way around, so all centres within PLACE_KM of a point lie in the 27 cells
    about it; a centre that moves changes its cell. A stay thus looks at few places, however many the entity has.
    """

    SIDE = PLACE_KM * (1 + 1e-9)

    def __init__(self) -> None:
        self.centres: list[tuple[float, float, int]] = []
        self.cells: dict[tuple[int, int, int], list[int]] = {}

    def _cell(self, lat: float, lon: float) -> tuple[int, int, int]:
        up, around = math.radians(lat), math.radians(lon)
        r = places.RADIUS_KM / self.SIDE
        return math.floor(r * math.cos(up) * math.cos(around)), math.floor(r * math.cos(up) * math.sin(around)), math.floor(r * math.sin(up))

    def join(self, lat: float, lon: float) -> int:
        """The number, from 0, of the first place within reach, which moves, or of a new one."""
        x, y, z = self._cell(lat, lon)
        near = (k for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for m in (z - 1, z, z + 1) for k in self.cells.get((i, j, m), ()))
        k = min((k for k in near if _km(self.centres[k][0], self.centres[k][1], lat, lon) <= PLACE_KM), default=None)
        if k is None:
            k = len(self.centres)
            self.centres.append((lat, lon, 1))
            self.cells.setdefault((x, y, z), []).append(k)
            return k
        a, b, n = self.centres[k]
        new = ((a * n + lat) / (n + 1), (b * n + lon) / (n + 1), n + 1)
        old, now = self._cell(a, b), self._cell(new[0], new[1])
        if old != now:
            self.cells[old].remove(k)
            self.cells.setdefault(now, []).append(k)
        self.centres[k] = new
        return k


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stays sorted by entity and time, with their place; state: the entity's places, never its stays."""
    entity, found = None, Centres()
    for batch in batches:
        out = []
        for who, lat, lon in zip(*(batch.column(c).to_pylist() for c in ("entity_id", "lat", "lon")), strict=True):
            if who != entity:
                entity, found = who, Centres()
            out.append(found.join(lat, lon) + 1)
        yield batch.append_column("place", pa.array(out, pa.int32()))


def place_of_stays(accepted: DataFrame) -> DataFrame:
    """The stays (dwell above 0) with their place: the first one within 0.3 km of its running centre, in order of time; else a new one."""
    d = accepted.where("dwell_min > 0")
    schema = d.withColumn("place", F.lit(None).cast("int")).schema
    return d.repartition("entity_id").sortWithinPartitions("entity_id", F.unix_micros("ts"), "sighting_id").mapInArrow(_cluster, schema)


def covered_dates(ts: Column, dwell_min: Column, hour: int, weekdays_only: bool = False) -> Column:
    """Local dates at whose given hour the stay lasts, ends included; none without a stay."""
    start = places.local(ts)
    end = F.timestamp_micros(F.unix_micros(start) + (dwell_min * 60_000_000).cast("long"))
    at = lambda day: day.cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    inside = lambda day: (at(day) >= start) & (at(day) <= end)
    keep = (lambda day: inside(day) & (F.weekday(day) <= 4)) if weekdays_only else inside
    return F.when(dwell_min > 0, F.filter(F.sequence(F.to_date(start), F.to_date(end)), keep)).otherwise(F.array().cast("array<date>"))


def _clock(minutes: Column) -> Column:
    m = F.floor(places.mean_clock_minutes(minutes) + 0.5)
    return F.format_string("%02d:%02d", F.floor(m / 60) % 24, m % 60)


def place_roles(accepted: DataFrame) -> DataFrame:
    """Each place's role: night, day, trip or episodic, with its counts, confidence and mean window of the stays that count."""
    d = place_of_stays(accepted).withColumn("nights", covered_dates(F.col("ts"), F.col("dwell_min"), NIGHT_HOUR))
    d = d.withColumn("weekdays", covered_dates(F.col("ts"), F.col("dwell_min"), DAY_HOUR, True))
    minute = lambda t: F.hour(t) * 60 + F.minute(t)
    start = places.local(F.col("ts"))
    end = F.timestamp_micros(F.unix_micros(start) + (F.col("dwell_min") * 60_000_000).cast("long"))
    window = lambda c: F.concat(_clock(F.when(F.size(c) > 0, minute(start))), F.lit("-"), _clock(F.when(F.size(c) > 0, minute(end))))
    dates = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    p = d.groupBy("entity_id", "place").agg(
        F.min_by("city", F.struct("ts", "sighting_id")).alias("city"), F.count("*").alias("n_stays"), (F.sum("dwell_min") / 60).alias("hours"), F.countDistinct(F.to_date(start)).alias("days"),
        dates("nights").alias("night_dates"), dates("weekdays").alias("day_dates"), window("nights").alias("night_window"), window("weekdays").alias("day_window"),
    )
    of_entity = Window.partitionBy("entity_id")
    for c in ("night", "day"):
        p = p.withColumn(f"n_{c}", F.size(f"{c}_dates").cast("long")).withColumn(f"all_{c}", F.size(F.array_distinct(F.flatten(F.collect_list(f"{c}_dates").over(of_entity)))))
    regular = {c: F.col(f"n_{c}") >= REGULAR for c in ("night", "day")}
    pick = lambda f, other: F.when(regular["night"], f("night")).when(regular["day"], f("day")).otherwise(other)
    p = p.withColumn("role", pick(F.lit, F.when(F.col("city") != "home", "trip").otherwise("episodic")))
    p = p.withColumn("confidence", pick(lambda c: places.regularity(F.col(f"n_{c}"), F.col(f"all_{c}")), None)).withColumn("window", pick(lambda c: F.col(f"{c}_window"), None))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in (("night", 0), ("day", 1), ("trip", 2), ("episodic", 3)) for x in kv]), F.col("role"))
    position = F.row_number().over(of_entity.orderBy(order, F.desc("hours"), "place")).cast("long")
    return p.select("entity_id", F.col("place").cast("long").alias("place"), position.alias("position"), "role", "city", "n_stays", "hours", "days", "n_night", "n_day", "confidence", "window")
