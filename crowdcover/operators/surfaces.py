"""Weather between stations: every method is a table of weights, so one join gives any series.

A value at a point is a weighted sum of the stations that report in that hour. For distance weights
that is plain; a surface of radial functions is linear in the values as well, so its system is
factored once per *set* of reporting stations, whatever the number of hours with that set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut

#: Stations and points meet in so many parts.
PARTS = 16
#: Points that one task places on a surface at a time.
BLOCK = 4096
#: Stations below which a surface is not determined.
LEAST = 4


def towards(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Every point next to every station: (cand, lat, lon, station, la, lo). A weight needs all of
    them; stations are dealt over parts and points sent to each, so no side is held by one task."""
    s = stations.select(F.col("station").cast("string").alias("station"), F.col("lat").cast("double").alias("la"),
                        F.col("lon").cast("double").alias("lo"))
    s = s.withColumn("_deel", F.pmod(F.xxhash64("station"), F.lit(PARTS)).cast("int"))
    p = points.select("cand", "lat", "lon").withColumn("_deel", F.explode(F.lit(list(range(PARTS)))))
    return p.join(s, "_deel").drop("_deel")


def distance_km() -> Column:
    return geo.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"), geo.SERIES_EARTH_KM)


def distance_weights(points: DataFrame, stations: DataFrame, power: float = 2.0) -> DataFrame:
    """``(cand, station, w)``: weight one over the distance (at least half a km) to a power."""
    return towards(points, stations).select("cand", "station", (
        1.0 / F.pow(F.greatest(distance_km(), F.lit(0.5)), F.lit(float(power)))).alias("w"))


def interpolate(reference: DataFrame, weights: DataFrame, variable: str = "T",
                keys: Sequence[str] = ("cand",)) -> DataFrame:
    """Weighted series per point: ``(time, *keys, x)``; a station without a value in an hour is
    left out of that hour."""
    ref = reference.where(F.col(variable).isNotNull()).select(
        "time", F.col("station").cast("string").alias("station"), F.col(variable).alias("_v"))
    return ref.join(weights, "station").groupBy("time", *keys).agg(
        (F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("x"))


def radial(r, kind: str, eps):
    """The radial function at distances ``r``."""
    if kind == "thin_plate":
        return r * r * np.log(r * r + 1e-300) / 2
    return np.sqrt(r * r / (eps * eps) + 1) if kind == "multiquadric" else r


def reporting_sets(reference: DataFrame, stations: DataFrame, variable: str) -> tuple[DataFrame, DataFrame]:
    """``(time, station, v, stel)``: the mean value of a station in an hour and the set of stations
    that report then; and ``(stel, station, x, y)``, the stations of every set in km."""
    place = stations.select(F.col("station").cast("string").alias("station"),
                            (F.col("lon") * geo.KM_LON).alias("x"), (F.col("lat") * geo.KM_LAT).alias("y"))
    values = reference.where(F.col(variable).isNotNull()).groupBy(
        "time", F.col("station").cast("string").alias("station")).agg(
            F.avg(F.col(variable).cast("double")).alias("v")).join(place.select("station"), "station")
    sets = values.groupBy("time").agg(F.array_sort(F.collect_list("station")).alias("_s")).where(
        F.size("_s") >= LEAST).withColumn("stel", F.md5(F.array_join("_s", "\n")))
    members = sets.groupBy("stel").agg(F.first("_s").alias("_s")).select(
        "stel", F.explode("_s").alias("station")).join(place, "station")
    return values.join(sets.select("time", "stel"), "time"), members


def solved_systems(members: DataFrame, kind: str) -> DataFrame:
    """``(stel, x, y, eps, a)``: per station of a set what the values of the set's stations, in order
    of place, add to its coefficient; the plane's three rows have no place. The stations of one set
    are in one task, which holds a square of their number."""
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("station")
        at, n = group[["x", "y"]].to_numpy(), len(group)
        apart = np.linalg.norm(at[:, None] - at, axis=2)
        eps = apart[apart > 0].mean() if apart.any() else 1.0
        system = radial(apart, kind, eps)
        if kind != "multiquadric":      # a plane beside the functions, of which they know nothing
            plane = np.pad(at, ((0, 0), (1, 0)), constant_values=1.0)
            system = np.pad(system, (0, 3))
            system[:n, n:], system[n:, :n] = plane, plane.T
        inverse = np.linalg.pinv(system, len(system) * np.finfo(float).eps)[:, :n]
        rows = [(group["stel"].iloc[0], i, *(at[i] if i < n else (None, None)), float(eps),
                 inverse[i].tolist()) for i in range(len(system))]
        return pd.DataFrame(rows, columns=["stel", "nr", "x", "y", "eps", "a"])

    return members.groupBy("stel").applyInPandas(
        solve, "stel string, nr int, x double, y double, eps double, a array<double>")


def radial_weights(members: DataFrame, points: DataFrame, kind: str) -> DataFrame:
    """``(stel, cand, station, w)``: what a station's value adds at a point while its set reports."""
    names = members.groupBy("stel").agg(F.array_sort(F.collect_list("station")).alias("namen"))
    systems = cut(solved_systems(members, kind).join(names, "stel"))
    blocks = -(-points.count() // BLOCK) or 1
    where = points.select("cand", (F.col("lon") * geo.KM_LON).alias("px"), (F.col("lat") * geo.KM_LAT).alias("py"),
                          F.pmod(F.xxhash64("cand"), F.lit(blocks)).cast("int").alias("blok"))
    every = F.explode(F.lit(list(range(blocks)))).alias("blok")
    # sets are sent to every block of points, and every block to each set
    points_of = members.select("stel").distinct().select("stel", every).join(where, "blok")

    def place(system: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["stel", "cand", "station", "w"])
        if not len(system) or not len(block):
            return out
        system = system.sort_values("nr")
        at = system[["x", "y"]].dropna().to_numpy(float)
        to = block[["px", "py"]].to_numpy()
        names = list(system["namen"].iloc[0])
        here = radial(np.linalg.norm(to[:, None] - at, axis=2), kind, system["eps"].iloc[0])
        if len(system) > len(at):
            here = np.hstack([here, np.ones((len(to), 1)), to])
        w = here @ np.array(system["a"].tolist())
        return pd.DataFrame({"stel": system["stel"].iloc[0], "cand": np.repeat(block["cand"].to_numpy(), len(names)),
                             "station": np.tile(names, len(to)), "w": w.ravel()})

    return systems.select("*", every).groupBy("stel", "blok").cogroup(
        points_of.groupBy("stel", "blok")).applyInPandas(
            place, "stel string, cand string, station string, w double")


def interpolate_rbf(reference: DataFrame, stations: DataFrame, points: DataFrame,
                    kind: str = "multiquadric", variable: str = "T") -> DataFrame:
    """Radial basis functions per hour from the stations with a value in that hour (at least
    four): ``(time, cand, x)``. Several values of a station in an hour count as their mean."""
    values, members = (cut(t) for t in reporting_sets(reference, stations, variable))
    weights = radial_weights(members, points, kind)
    return values.join(weights, ["stel", "station"]).groupBy("time", "cand").agg(
        F.sum(F.col("w") * F.col("v")).alias("x"))


def two_nearest(points: DataFrame, stations: DataFrame) -> DataFrame:
    """``(cand, stations)``: the two nearest stations of every point, in order of name."""
    near = towards(points, stations).groupBy("cand").agg(
        F.min(F.struct(distance_km().alias("km"), "station")).alias("_1"))
    other = towards(points, stations).join(near, "cand").where(
        F.col("station") != F.col("_1.station")).groupBy("cand", "_1").agg(
            F.min(F.struct(distance_km().alias("km"), "station")).alias("_2"))
    pair = F.array_sort(F.filter(F.array("_1.station", "_2.station"), lambda s: s.isNotNull()))
    return near.join(other.select("cand", "_2"), "cand", "left").select(
        "cand", F.array_join(pair, "|").alias("stations"))
