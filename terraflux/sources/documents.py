"""GeoJSON documents in a stored table: add, update, delete, get, and queries by example."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ecql import Layout, mongo
from . import storage

_SCHEMA = "type string, id string, geometry struct<type: string, coordinates: array<double>>, properties string"


class GeoJsonIndex:
    """An index of point features under ``path``. Documents are a DataFrame with a column ``json``; the
    id is the feature's, or the value at ``id_path`` within it (such as $.properties.name)."""

    def __init__(self, spark: SparkSession, path: str, id_path: str = "$.id"):
        self.spark, self.path, self.id_path = spark, path.rstrip("/"), id_path

    def _rows(self, docs: DataFrame) -> DataFrame:
        of = lambda p: F.get_json_object("json", p)
        return docs.select(of(self.id_path).alias("id"), of("$.geometry.coordinates[0]").cast("double").alias("lon"), of("$.geometry.coordinates[1]").cast("double").alias("lat"), of("$.properties").alias("properties"), "json")

    def add(self, docs: DataFrame) -> None:
        storage.write(self._rows(docs), self.path, "z2-4bits", lon="lon", lat="lat")

    def update(self, docs: DataFrame) -> None:
        """Replace documents by id; new ones are added."""
        rows = self._rows(docs)
        storage.update(self.spark, self.path, rows.withColumn("partition", storage.partition_value("z2-4bits", lon="lon", lat="lat")), "id")

    def delete(self, ids: DataFrame) -> None:
        """ids: a column ``id``."""
        storage.update(self.spark, self.path, ids.select("id"), "id", delete=True)

    def all(self) -> DataFrame:
        return storage.read(self.spark, self.path).select("id", "lon", "lat", "properties", "json")

    def get(self, *ids: str) -> DataFrame:
        return self.all().where(F.col("id").isin(*ids)).select("id", "json")

    def query(self, example: dict, fields: dict[str, str] | None = None) -> DataFrame:
        """Documents that an example fits: geom for the place, properties.x for what they hold. fields:
        names of result columns and their JSON paths, in place of the document."""
        rows = self.all()
        found = rows.where(mongo(example, Layout(rows.schema, points={"geom": ("lon", "lat")}, fid="id")))
        return found.select("id", *([F.get_json_object("json", p).alias(n) for n, p in fields.items()] if fields else ["json"]))
