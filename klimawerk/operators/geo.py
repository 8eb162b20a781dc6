"""Shapes as tables of rings and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounding_box(rings: DataFrame) -> DataFrame:
    """Smallest box that holds all rings; the box of each ring is taken before anything is exchanged."""
    lon, lat = F.transform("ring", lambda p: F.get(p, F.lit(0))), F.transform("ring", lambda p: F.get(p, F.lit(1)))
    return rings.agg(
        F.min(F.array_min(lon)).alias("xmin"),
        F.min(F.array_min(lat)).alias("ymin"),
        F.max(F.array_max(lon)).alias("xmax"),
        F.max(F.array_max(lat)).alias("ymax"),
    )


def boundary_edges(rings: DataFrame) -> DataFrame:
    """Distinct edges of all rings; a border shared by two shapes appears once.

    Exact where neighbours share vertices; crossing lines are not split.
    """
    starts = F.slice("ring", F.lit(1), F.size("ring") - 1)
    ends = F.slice("ring", F.lit(2), F.size("ring") - 1)
    edge = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    edges = rings.filter(F.size("ring") > 1).select(F.explode(edge).alias("e"))
    point = lambda side: F.struct(F.get(f"e.{side}", F.lit(0)).alias("x"), F.get(f"e.{side}", F.lit(1)).alias("y"))
    low, high = F.least(point("a"), point("b")), F.greatest(point("a"), point("b"))
    return edges.select(
        low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2")
    ).distinct()
