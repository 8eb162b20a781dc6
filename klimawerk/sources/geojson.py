"""GeoJSON feature collections as tables.

A small file that is one pretty-printed document is read with ``multiline=True``, each file in one task. Collections that come as
many documents, one per line, are split like any text. ``read_large_collections`` splits documents of any layout and size.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions that run inside tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Coordinates stay text until the geometry type is known, because their nesting depth depends on it.
_FEATURE = (
    "properties: struct<name: string, number: string, height: double>, "
    "geometry: struct<type: string, coordinates: string>"
)
_DOCUMENT = f"type string, features array<struct<{_FEATURE}>>"

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_OPENING = re.compile(r'\\.|["{]', re.DOTALL)


def read_feature_collections(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    return spark.read.schema(_DOCUMENT).option("multiLine", multiline).json(path)


def parse_feature_collections(documents: DataFrame, column: str = "document") -> DataFrame:
    """The same as a read, for documents that are already a text column."""
    return documents.select(F.from_json(column, _DOCUMENT).alias("d")).select("d.*")


def read_large_collections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Collections of one feature each, from documents that many tasks read together.

    The text is split at closing braces. A first pass counts quotes and braces of each input split, which tells whether the next
    one begins inside a string and how deep; the second cuts out the objects inside the documents, and only those that cross
    splits are put together by a shuffle. What is broadcast is a row per input split.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")
    )
    order = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.mapInArrow(_counted, "file string, begin bigint, quotes bigint, plain bigint, quoted bigint")
    inside = F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2 == 1
    deeper = splits.withColumn("inside", inside).withColumn("deeper", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain")))
    state = deeper.select("file", "begin", "inside", F.coalesce(F.sum("deeper").over(order), F.lit(0)).alias("depth"))
    # A broadcast keeps the order of the pieces within their split.
    cut = pieces.join(F.broadcast(state), ["file", "begin"]).select("value", "file", "begin", "inside", "depth").mapInArrow(
        _objects, "file string, begin bigint, opened boolean, closed boolean, object string"
    )
    whole = cut.where("opened and closed").select("object")
    parts = cut.where("not (opened and closed)")
    before = Window.partitionBy("file").orderBy("begin", "opened").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("opened").cast("int")).over(before)
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("begin", "object"))).alias("parts")
    )
    objects = whole.unionByName(joined.select(F.array_join("parts.object", "").alias("object")))
    feature = F.from_json("object", f"struct<type: string, {_FEATURE}>")
    return objects.select(feature.alias("f")).where("f.type = 'Feature'").select(
        F.lit("FeatureCollection").alias("type"), F.array(F.struct("f.properties", "f.geometry")).alias("features")
    )


def _runs(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    """(file, begin, further columns, text with its closing brace) of each piece, in order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in (1, 2, *columns)), (f"{t}}}" for t in batch.column(0).to_pylist()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each input split, and by how much braces outside quotes, and inside them, go deeper."""
    found: dict[tuple, list[int]] = {}
    for file, begin, text in _runs(batches):
        sums = found.setdefault((file, begin), [0, 0, 0])
        for i, zone in enumerate(_ESCAPED.sub("", text).split('"')):
            sums[0] += i > 0
            sums[1 + sums[0] % 2] += zone.count("{") - zone.count("}")
    if found:
        columns = [*zip(*found), *zip(*found.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "begin", "quotes", "plain", "quoted"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects right below the documents' own, whole or the part that lies in a split."""
    out: list[tuple] = []

    def handed() -> pa.RecordBatch:
        fields = ["file", "begin", "opened", "closed", "object"]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], fields)
        out.clear()
        return batch

    at, held, opened, inside, depth = None, [], False, False, 0
    for file, begin, starts_inside, starts_depth, text in _runs(batches, 3, 4):
        if (file, begin) != at:
            if held:
                out.append((*at, opened, False, "".join(held)))
            at, held, opened, inside, depth = (file, begin), [], False, starts_inside, starts_depth
        first = 0
        zones = _ESCAPED.sub("", text).split('"')
        opening = sum(z.count("{") for z in zones[int(inside)::2])
        if depth < 2 <= depth + opening:
            first, opened = _nth_opening(text, inside, 2 - depth), True
        inside ^= len(zones) % 2 == 0
        before, depth = depth + opening, depth + opening - (not inside)
        if before >= 2:
            held.append(text[first:])
            if depth < 2:
                out.append((*at, opened, True, "".join(held)))
                held, opened = [], False
                if len(out) >= 1 << 12:
                    yield handed()
    if held:
        out.append((*at, opened, False, "".join(held)))
    if out:
        yield handed()


def _nth_opening(text: str, inside: bool, n: int) -> int:
    """Place of the ``n``-th opening brace outside quotes."""
    for match in _OPENING.finditer(text):
        if match.group() == '"':
            inside = not inside
        elif match.group() == "{" and not inside:
            n -= 1
            if not n:
                return match.start()
    raise ValueError("fewer braces than counted")


def _features(collections: DataFrame) -> DataFrame:
    # An outer explode followed by a filter: a plain one makes Spark test the array before, which parses each document twice.
    features = collections.select(F.explode_outer("features").alias("f")).filter(F.col("f").isNotNull())
    return features.select(
        "f.properties.*", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates")
    )


def station_points(collections: DataFrame) -> DataFrame:
    """Station dimension: name, number, height, lon, lat."""
    point = F.from_json("coordinates", "array<double>")
    return (
        _features(collections)
        .filter(F.col("geometry") == "Point")
        .select("name", "number", "height", F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))
    )


def outline_rings(collections: DataFrame) -> DataFrame:
    """One row per closed ring of a polygon or multipolygon: name, ring (array of [lon, lat])."""
    polygon = F.from_json("coordinates", "array<array<array<double>>>")
    multipolygon = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry") == "Polygon", polygon).when(F.col("geometry") == "MultiPolygon", multipolygon)
    return _features(collections).select("name", F.explode_outer(rings).alias("ring")).filter(F.col("ring").isNotNull())
