"""GeoJSON, GeoJSON text sequences and newline-delimited features, to and from feature rows.

Rows: source, feature_seq, fid, fid_type, geom_type, geometry (JSON), props
(VARIANT); readers also give an errors table: source, record, code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
RS = "\x1e"


def text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def features_of(v: Column) -> Column:
    """The features of a document, as an array of VARIANT: of a collection, a feature, or a bare geometry."""
    kind = text_of(v, "$.type")
    wrapped = F.try_parse_json(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.to_json(v), F.lit("}")))
    return F.when(kind == "FeatureCollection", F.try_variant_get(v, "$.features", "array<variant>")).when(kind == "Feature", F.array(v)).when(kind.isin(*TYPES), F.array(wrapped))


def positions(geometry: Column) -> Column:
    """All positions of a geometry other than a collection, as arrays of doubles; null where one isn't an array of numbers."""
    kind = text_of(geometry, "$.type")
    get = lambda depth: F.try_variant_get(geometry, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    return (
        F.when(kind == "Point", F.array(get(1)))
        .when(kind.isin("MultiPoint", "LineString"), get(2))
        .when(kind.isin("MultiLineString", "Polygon"), F.flatten(get(3)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(get(4))))
    )


def feature_code(v: Column) -> Column:
    """Why a feature is refused, or null."""
    geometry = F.try_variant_get(v, "$.geometry", "variant")
    kind = text_of(geometry, "$.type")
    absent = geometry.isNull()
    lines = F.when(kind == "LineString", F.array(F.try_variant_get(geometry, "$.coordinates", "array<array<double>>"))).when(kind == "MultiLineString", F.try_variant_get(geometry, "$.coordinates", "array<array<array<double>>>"))
    rings = F.when(kind == "Polygon", F.try_variant_get(geometry, "$.coordinates", "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.try_variant_get(geometry, "$.coordinates", "array<array<array<array<double>>>>")))
    bad = F.exists(positions(geometry), lambda p: p.isNull() | (F.size(p) < 2) | F.exists(p, lambda c: c.isNull() | F.isnan(c)))
    return (
        F.when(text_of(v, "$.type") != "Feature", "feature")
        .when(absent, "geometry")
        .when(F.is_variant_null(geometry), None)
        .when(kind.isNull() | ~kind.isin(*TYPES), "geometry-type")
        .when(kind == "GeometryCollection", None)
        .when(positions(geometry).isNull() | F.coalesce(bad, F.lit(True)), "coordinate")
        .when(F.exists(lines, lambda x: F.size(x) < 2), "line-length")
        .when(F.exists(rings, lambda r: F.size(r) < 4), "ring-length")
        .when(F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1)), "ring-open")
    )


def numbered(rows: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of a read, with feature_seq a number for each row of it: unique over its files, ascending within each split, and never too large."""
    return rows[0].withColumn("feature_seq", F.monotonically_increasing_id()), rows[1]


def to_rows(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(source, record, v): the feature rows and the errors. A record with a bad feature gives none of its features.

    feature_seq is record * 2**32 and the feature's place in its record: unique
    within a source whose records are numbered.
    """
    opened = records.withColumn("features", features_of(F.col("v")))
    # the first code of a record's features, within the record: no join and no shuffle
    code = F.get(F.filter(F.transform("features", feature_code), lambda c: c.isNotNull()), F.lit(0))
    refused = F.when(F.col("v").isNull(), "json").when(F.col("features").isNull(), "type").otherwise(code)
    errors = opened.select("source", "record", refused.alias("code")).filter("code is not null")
    good = opened.select("source", "record", F.posexplode_outer(F.when(code.isNull(), F.col("features"))).alias("place", "f")).filter("place is not null")
    given = F.try_variant_get("f", "$.id", "variant")
    kind = F.schema_of_variant(given)
    props = F.try_variant_get("f", "$.properties", "variant")
    geometry = F.try_variant_get("f", "$.geometry", "variant")
    rows = good.select(
        "source",
        (F.col("record") * F.lit(1 << 32) + F.col("place")).alias("feature_seq"),
        F.when(kind != "VOID", F.variant_get(given, "$", "string")).alias("fid"),
        F.when(kind == "STRING", "str").when(kind != "VOID", "num").alias("fid_type"),
        text_of(geometry, "$.type").alias("geom_type"),
        F.when(~F.is_variant_null(geometry), F.to_json(geometry)).alias("geometry"),
        F.coalesce(props, F.parse_json(F.lit("{}"))).alias("props"),
    )
    return rows, errors


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents, one a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return numbered(to_rows(files.select("source", F.lit(1).cast("long").alias("record"), F.try_parse_json("value").alias("v"))))


def read_feature_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A feature a line: files of any size, split between tasks. `record` is the place of a line within the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("record"), "value")
    return numbered(to_rows(lines.select("source", "record", F.try_parse_json("value").alias("v"))))


def sequence_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and errors of files(source, value) of records framed by RS.

    Text before the first must be blank; blank records are skipped but counted.
    """
    each = files.select("source", F.posexplode(F.split("value", RS)).alias("record", "value"))
    kept = each.filter(F.col("value").rlike(r"\S"))
    lead = kept.filter("record = 0").select("source", F.lit(0).cast("long").alias("record"), F.lit("leading-text").alias("code"))
    rows, errors = to_rows(kept.filter("record > 0").select("source", F.col("record").cast("long").alias("record"), F.try_parse_json("value").alias("v")))
    return rows, errors.unionByName(lead)


def read_sequence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of files of any size, which are split at RS between tasks. `record` is the place of a record within the read."""
    read = spark.read.option("lineSep", RS).text(path)
    each = read.select(F.input_file_name().alias("source"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("record"), "value")
    # what is before the first RS of a file is no record: one row for each file
    first = each.filter("start = 0").groupBy("source").agg(F.min("record").alias("record"), F.min_by("value", "record").alias("value"))
    lead = first.filter(F.col("value").rlike(r"\S")).select("source", "record", F.lit("leading-text").alias("code"))
    kept = each.filter(F.col("value").rlike(r"\S")).join(first.select("source", "record"), ["source", "record"], "left_anti")
    rows, errors = numbered(to_rows(kept.select("source", "record", F.try_parse_json("value").alias("v"))))
    return rows, errors.unionByName(lead)


def read_geojson_seq(spark: SparkSession, path: str, on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    rows, errors = numbered(sequence_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")))
    if on_error == "fail":
        first = errors.orderBy("source", "record").first()
        if first is not None:
            raise ValueError(f"record {first.record} of {first.source}: {first.code}")
    return rows, errors


def format_of(value: Column) -> Column:
    """geojsonseq, osm, topojson, geojson or null. A sequence is told by its first sign; the rest is parsed."""
    v = F.try_parse_json(F.when(~value.rlike(r"^\s*\x1e"), value))
    kind = text_of(v, "$.type")
    return F.when(value.rlike(r"^\s*\x1e"), "geojsonseq").when(F.schema_of_variant(F.try_variant_get(v, "$.elements", "variant")).startswith("ARRAY"), "osm").when(kind == "Topology", "topojson").when(kind.isin("FeatureCollection", "Feature", *TYPES), "geojson")


def detect(spark: SparkSession, path: str) -> DataFrame:
    """source and format of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), format_of(F.col("value")).alias("format"))


def feature_json(fid: Column, fid_type: Column, geometry: Column, props: Column) -> Column:
    """A feature as text; no id member for a null id. geometry and props are JSON text."""
    ident = F.when(fid.isNull(), "").when(fid_type == "num", F.concat(F.lit(',"id":'), fid)).otherwise(F.concat(F.lit(',"id":'), F.substring(F.to_json(F.array(fid)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(fid))) - 2)))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce(props, F.lit("null")), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), ident, F.lit("}"))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """A feature a line, in files by feature_seq."""
    rows = features.select("feature_seq", feature_json(F.col("fid"), F.col("fid_type"), F.col("geometry"), F.to_json("props")).alias("value"))
    rows.repartitionByRange("feature_seq").sortWithinPartitions("feature_seq").select("value").write.text(path)
