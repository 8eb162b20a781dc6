"""A store of cleaned stations in versions: stations are added or renewed alone, and readers keep the version they opened.

Each change writes the cleaned rows of its stations and their monthly partial sums to a new part and lists these stations beside it; nothing is ever
written into an existing folder. A version is a small file that names its parts in order, put in place by a rename as the last step.
A change that fails before that leaves the current version as it was, and of two changes made at once the second to finish
fails. A station's rows are those of the last part that lists it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from klimawerk.operators.cleaning import clean
from klimawerk.operators.partials import monthly_partials
from klimawerk.sources.materialised import read_clean, write_clean

MAX_PARTS = 16
"""Parts of a version beyond which a change rewrites the live rows as one part."""


class StationStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # Files of versions, in whatever file system the path is

    def _files(self):
        at = self._hadoop.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Numbers of all versions, the current one last."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        files = self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _parts(self, version: int) -> list[dict]:
        """Names and schemas of a version's parts, oldest first; version 0 is empty."""
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def _commit(self, version: int, parts: list[dict]) -> None:
        """Make ``version`` current; an error if another change has made it meanwhile."""
        files = self._files()
        new = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = files.create(new, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        finally:
            out.close()
        target = self._hadoop.Path(f"{self.path}/versions/{version}.json")
        if files.exists(target) or not files.rename(new, target):
            files.delete(new, False)
            raise RuntimeError(f"version {version} of {self.path} was made by another change")

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The cleaned daily table of the current or of a given version. Later changes do not touch its files."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path} holds no version")
        if version is not None and version not in known:
            raise ValueError(f"{self.path} holds no version {version}")
        return self._live(self._parts(version or known[-1]))

    def read_months(self, version: int | None = None) -> DataFrame:
        """The monthly partial sums of the same rows, see ``operators.partials``."""
        known = self.versions()
        return self._live(self._parts(version or known[-1]), "months")

    def _live(self, parts: list[dict], table: str = "days") -> DataFrame:
        out = None
        newer = None
        for part in reversed(parts):
            folder = f"{self.path}/parts/{part['name']}"
            rows = read_clean(self.spark, f"{folder}/{table}", StructType.fromJson(part[table]))
            stations = self.spark.read.schema("station_id string").parquet(f"{folder}/stations")
            rows = rows if newer is None else rows.join(newer, "station_id", "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
            newer = stations if newer is None else newer.union(stations)
        return out

    # Changes

    def put(self, raw: DataFrame) -> int:
        """Clean the raw rows of some stations and make them the stations' rows; the number of the new version.

        ``raw`` holds each station's whole record, because gaps are filled from all its years. Only these stations are cleaned;
        one that has no complete year is listed without rows. All other stations stay as they are.
        """
        before = self.versions()[-1:]
        version = before[0] if before else 0
        parts = [*self._parts(version), self._write(clean(raw), raw.select("station_id"))]
        if len(parts) > MAX_PARTS:
            live = self._live(parts)
            parts = [self._write(live, live.select("station_id"))]
        self._commit(version + 1, parts)
        return version + 1

    def compact(self) -> int:
        """The current rows as one part, as a new version."""
        version = self.versions()[-1]
        live = self._live(self._parts(version))
        self._commit(version + 1, [self._write(live, live.select("station_id"))])
        return version + 1

    def _write(self, days: DataFrame, stations: DataFrame) -> dict:
        name = uuid.uuid4().hex
        folder = f"{self.path}/parts/{name}"
        write_clean(days, f"{folder}/days")
        months = monthly_partials(read_clean(self.spark, f"{folder}/days", days.schema))
        months.hint("rebalance", "station_id").sortWithinPartitions("station_id", "Jahr", "Monat").write.parquet(f"{folder}/months")
        stations.distinct().write.parquet(f"{folder}/stations")
        # With their schemas, as a part may hold no row to tell them from.
        return {"name": name, "days": days.schema.jsonValue(), "months": months.schema.jsonValue()}

    def expire(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and parts that no kept version names. Their readers must have finished.

        Parts of changes that have not been committed go too, so no change may be under way.
        """
        files = self._files()
        known = self.versions()
        kept = known[-max(keep, 1):]
        for version in set(known) - set(kept):
            files.delete(self._hadoop.Path(f"{self.path}/versions/{version}.json"), False)
        named = {part["name"] for version in kept for part in self._parts(version)}
        for status in files.listStatus(self._hadoop.Path(f"{self.path}/parts")):
            if status.getPath().getName() not in named:
                files.delete(status.getPath(), True)
