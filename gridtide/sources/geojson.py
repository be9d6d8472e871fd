"""Cell geometry from GeoJSON feature collections.

A feature collection is one JSON document, so a file is parsed by one task; a reference split over
several files is read in parallel.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS = T.ArrayType(T.ArrayType(T.DoubleType()))
POLYGON = T.ArrayType(POSITIONS)
MULTI_POLYGON = T.ArrayType(POLYGON)

_GEOMETRY = "struct<type string, coordinates string>"
_PROPERTIES = "struct<cellId string, cell_id string, id string>"
COLLECTION = (
    f"type string, features array<struct<type string, id string, properties {_PROPERTIES}, "
    f"geometry {_GEOMETRY}>>"
)


def read_features(spark, path):
    """One row per feature: candidate ids, geometry type and raw coordinates. Raises when there is none."""
    collection = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    features = collection.select(F.col("type").alias("collection_type"), F.explode("features").alias("f"))
    if features.isEmpty():
        raise ValueError(f"no features found in {path}")
    return features.select("collection_type", "f.*")


def _filled(name):
    """An id that is present and truthy: empty text and zero fall through to the next candidate."""
    value = F.col(name)
    return F.when((value != "") & ~value.isin("0", "0.0", "false"), value)


def feature_id(fallback=False):
    """Cell id of a feature; with `fallback` the first usable of cellId, cell_id, id and the feature id."""
    first = F.col("properties.cellId")
    if fallback:
        names = ("properties.cellId", "properties.cell_id", "properties.id", "id")
        first = F.coalesce(*[_filled(name) for name in names])
    return first.try_cast("double").cast("long")


def _geometry_json():
    """The geometry re-assembled as GeoJSON text; coordinates stay exactly as written."""
    kind, places = F.col("geometry.type"), F.col("geometry.coordinates")
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), places, F.lit("}"))


def grid_reference(features, id_offset=0, fallback=False):
    """(grid_id, geometry JSON); features without id or geometry are skipped."""
    identified = features.select((feature_id(fallback) + id_offset).alias("grid_id"), _geometry_json().alias("geometry"))
    return identified.where(F.col("grid_id").isNotNull() & F.col("geometry").isNotNull())


def vertices(kind, coordinates):
    """All [lon, lat] positions of a Polygon or MultiPolygon, NULL for any other type."""
    rings = F.flatten(F.from_json(coordinates, POLYGON))
    polygons = F.flatten(F.flatten(F.from_json(coordinates, MULTI_POLYGON)))
    return F.when(kind == "Polygon", rings).when(kind == "MultiPolygon", polygons)


def exterior_ring(kind, coordinates):
    """Positions of the outer ring of a Polygon."""
    return F.when(kind == "Polygon", F.get(F.from_json(coordinates, POLYGON), F.lit(0)))


def _mean_of(points, place):
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[place])
    return F.try_divide(total, F.size(points))


def centroids(features, id_offset=0, exterior_only=False):
    """(grid_id, centroid_latitude, centroid_longitude): mean of the vertices, closing vertex included.

    Unsupported geometry types, empty coordinates and missing ids are skipped.
    """
    pick = exterior_ring if exterior_only else vertices
    points = pick(F.col("geometry.type"), F.col("geometry.coordinates"))
    placed = features.select((feature_id() + id_offset).alias("grid_id"), points.alias("points"))
    return placed.where(F.col("grid_id").isNotNull() & (F.size("points") > 0)).select(
        "grid_id",
        _mean_of(F.col("points"), 1).alias("centroid_latitude"),
        _mean_of(F.col("points"), 0).alias("centroid_longitude"),
    )


def structure_report(features):
    """One row: collection type, number of features, and id location, geometry type and rings of a sample."""
    names = {
        "features[].properties.cellId": "properties.cellId",
        "features[].properties.cell_id": "properties.cell_id",
        "features[].properties.id": "properties.id",
        "features[].id": "id",
    }
    location = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(text)) for text, c in names.items()])
    sample = F.struct(
        F.coalesce(location, F.lit("Unknown property key")).alias("grid_id_location"),
        F.coalesce(*[F.col(c) for c in names.values()]).alias("sample_grid_id"),
        F.coalesce(F.col("geometry.type"), F.lit("Unknown")).alias("geometry_type"),
        F.coalesce(
            F.size(F.from_json("geometry.coordinates", "array<string>")), F.lit(0)
        ).alias("sample_coordinates_rings"),
    )
    return features.agg(
        F.first("collection_type").alias("top_level_type"),
        F.count(F.lit(1)).alias("total_features"),
        F.first(sample).alias("s"),
    ).select("top_level_type", "total_features", "s.*")
