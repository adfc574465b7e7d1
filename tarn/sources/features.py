"""Vector features as they come: GeoJSON records, land-cover GML, survey layers. Parsed by expressions where JSON allows, else by partition."""

from __future__ import annotations

import io
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The geometry and properties that are read of a feature; properties stay a map, since layers name them differently.
FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def parse_features(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``pos, kind, coordinates`` (JSON text)``, properties`` of GeoJSON features in ``pos, raw``; what is no JSON, or has no geometry, is left out."""
    f = F.from_json(column, FEATURE)
    return raw.withColumn("f", f).where("f.geometry.coordinates is not null").select("pos", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def line_vertices(features: DataFrame) -> DataFrame:
    """``pos, part, ord, x, y`` of line features, one part for each line of a multi-line."""
    single = F.from_json("coordinates", "array<array<double>>")
    multi = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("kind") == "LineString", F.array(single)).when(F.col("kind") == "MultiLineString", multi)
    each = features.select("pos", F.posexplode(parts).alias("part", "line")).select("pos", "part", F.posexplode("line").alias("ord", "p"))
    return each.select("pos", "part", "ord", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def polygon_rings(features: DataFrame) -> DataFrame:
    """``pos, ring, ord, x, y`` of polygon features; the rings of all parts are counted through."""
    single = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", F.flatten(multi))
    each = features.select("pos", F.posexplode(rings).alias("ring", "line")).select("pos", "ring", F.posexplode("line").alias("ord", "p"))
    return each.select("pos", "ring", "ord", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def river_attributes(features: DataFrame, names: dict[str, str | None], default_order: int = 2) -> DataFrame:
    """``pos, feature_id, order, river_no, date`` by the resolved field names; orders are rounded and kept in 1 to 255."""
    get = lambda field: F.col("properties")[names[field]] if names.get(field) else F.lit(None).cast("string")
    order = F.rint(get("order").try_cast("double")).cast("int")
    return features.select(
        "pos",
        get("id").try_cast("double").cast("long").alias("feature_id"),
        F.coalesce(F.least(F.greatest(order, F.lit(1)), F.lit(255)), F.lit(default_order)).alias("order"),
        F.nullif(F.trim(get("river_no")), F.lit("")).alias("river_no"),
        get("date").alias("date"),
    )


def lake_attributes(features: DataFrame, names: dict[str, str | None]) -> DataFrame:
    """``pos, lake_no, name, published, area_m2, regulated``; areas given in square kilometres by their field's name are converted."""
    get = lambda field: F.col("properties")[names[field]] if names.get(field) else F.lit(None).cast("string")
    scale = 1e6 if "km2" in (names.get("area") or "").lower() else 1.0
    level = get("level").try_cast("double")
    return features.select(
        "pos",
        get("id").try_cast("double").cast("long").alias("lake_no"),
        F.nullif(F.trim(get("name")), F.lit("")).alias("name"),
        F.when(level > 0, level).alias("published"),
        (get("area").try_cast("double") * scale).alias("area_m2"),
        F.coalesce(F.contains(F.lower(get("kind")), F.lit("regulert")), F.lit(False)).alias("regulated"),
    )


def to_geojson(lines: DataFrame) -> DataFrame:
    """``seg_id, json``: a LineString feature of each line's vertices (``seg_id, ord, x, y``)."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("seg_id").alias("properties"))
    return lines.groupBy("seg_id").agg(points.alias("points")).select("seg_id", F.to_json(feature).alias("json"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_land_cover(files: DataFrame, bbox: tuple[float, float, float, float], kinds: tuple[str, ...] = ("ElvBekk", "Elv")) -> DataFrame:
    """``id, kind, width_class, ring, points`` of river features in GML files (``path, content``) whose boxes meet ``bbox``, streamed element by element."""
    x0, y0, x1, y1 = bbox

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                for _, e in ElementTree.iterparse(io.BytesIO(content)):
                    if _local(e.tag) not in ("featureMember", "member"):
                        continue
                    for own in e:
                        inner = {_local(c.tag): (c.text or "").strip() for c in own.iter()}
                        if _local(own.tag) not in kinds and inner.get("objtype") not in kinds:
                            continue
                        name = next((v for k, v in own.attrib.items() if _local(k) == "id"), None)
                        lists = [list(map(float, (c.text or "").split())) for c in own.iter() if _local(c.tag) == "posList"]
                        xs, ys = [v for p in lists for v in p[::2]], [v for p in lists for v in p[1::2]]
                        if not xs or max(xs) < x0 or min(xs) > x1 or max(ys) < y0 or min(ys) > y1:
                            continue
                        width = inner.get("vannbredde", "")
                        rows += [(name, inner.get("objtype") or _local(own.tag), int(width) if width.isdigit() else None, k, p) for k, p in enumerate(lists)]
                    e.clear()
            out = pd.DataFrame(rows, columns=["id", "kind", "width_class", "ring", "points"])
            out["width_class"] = out["width_class"].astype("Int64")
            yield out

    return files.select("content").mapInPandas(run, "id string, kind string, width_class int, ring int, points array<double>")


def distinct_features(features: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """The first record of each ``key``."""
    return features.groupBy(key).agg(F.min_by(F.struct(*(c for c in features.columns if c != key)), position).alias("b")).select(key, "b.*")
