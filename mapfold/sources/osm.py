"""OSM elements to features: joins for ways and relations, a walk for rings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import last_per_key
from ..operators.rings import ring_positions

# Tags that make a closed way an area, whatever their value.
AREA_TAGS = "landuse landcover amenity shop tourism office military".split()
# Tags that do so unless they have this value.
AREA_UNLESS = {"building": "no", "building:part": "no", "leisure": "track"}
# Tags that do so with one of these values.
AREA_VALUES = {
    "natural": "water wood scrub wetland grassland heath sand beach bare_rock scree shingle glacier mud fell".split(),
    "waterway": ["riverbank"],
    "aeroway": "aerodrome apron helipad".split(),
}


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """source, idx, type, id, lon, lat, tags, nodes, members of OSM JSON files; a remark in a file is an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.try_parse_json("value").alias("v"))
    remark = files.filter(F.try_variant_get("v", "$.remark", "string").isNotNull()).first()
    if remark is not None:
        raise ValueError(f"{remark.source} has a remark: it isn't whole")
    return elements_of(files)


def elements_of(files: DataFrame) -> DataFrame:
    """The elements of files(source, v)."""
    each = files.select("source", F.posexplode(F.try_variant_get("v", "$.elements", "array<variant>")).alias("idx", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    member = "array<struct<type:string,ref:bigint,role:string>>"
    return each.select("source", "idx", get("$.type", "string").alias("type"), get("$.id", "bigint").alias("id"), get("$.lon", "double").alias("lon"), get("$.lat", "double").alias("lat"), get("$.tags", "map<string,string>").alias("tags"), get("$.nodes", "array<bigint>").alias("nodes"), get("$.members", member).alias("members"))


def last_statements(elements: DataFrame) -> DataFrame:
    """Of elements that are stated again the last, at its own place."""
    return last_per_key(elements, ["type", "id"], ["idx"])


def way_lines(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, line (array of x, y), refs of way_nodes(way_id, pos, node_id); a way that lacks a node gives none."""
    found = way_nodes.join(nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "node_id", "left")
    rows = found.groupBy("way_id").agg(F.count("*").alias("n"), F.count("x").alias("there"), F.array_sort(F.collect_list(F.struct("pos", "x", "y", "node_id"))).alias("steps"))
    return rows.filter("n = there and n >= 2").select("way_id", F.transform("steps", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("line"), F.transform("steps", lambda s: s["node_id"]).alias("refs"))


def broken_ways(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and code of the ways that way_lines leaves out."""
    missing = way_nodes.join(nodes.select("node_id"), "node_id", "left_anti").select("way_id").distinct().withColumn("code", F.lit("missing-node"))
    short = way_nodes.groupBy("way_id").agg(F.count("*").alias("n")).filter("n < 2").select("way_id", F.lit("short").alias("code"))
    return missing.unionByName(short.join(missing, "way_id", "left_anti"))


def is_area(tags: Column) -> Column:
    """area=yes or no decides, else the tags above; an empty value is none."""
    area, found = tags["area"], F.lit(False)
    for tag in AREA_TAGS:
        found = found | (F.coalesce(tags[tag], F.lit("")) != "")
    for tag, but in AREA_UNLESS.items():
        found = found | ~F.coalesce(tags[tag], F.lit("")).isin("", but)
    for tag, values in AREA_VALUES.items():
        found = found | F.coalesce(tags[tag].isin(*values), F.lit(False))
    return F.when(area == "yes", True).when(area == "no", False).otherwise(found)


def way_class(lines: DataFrame) -> DataFrame:
    """lines(way_id, refs, tags) with geom_type: Polygon for closed ways of at least four nodes that are areas."""
    closed = (F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1))
    return lines.withColumn("geom_type", F.when(closed & F.coalesce(is_area(F.col("tags")), F.lit(False)), "Polygon").otherwise("LineString"))


def relation_lines(members: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, pos, role, line, code of members(relation_id, pos, type, ref, role): the default role is outer.

    Members of other roles that aren't ways are left out. code tells why a
    member spoils its relation: not-a-way, role or missing-way.
    """
    role = F.when(F.coalesce("role", F.lit("")) == "", "outer").otherwise(F.col("role"))
    rows = members.withColumn("role", role).filter((F.col("type") == "way") | F.col("role").isin("outer", "inner"))
    joined = rows.join(lines.select(F.col("way_id").alias("ref"), "line"), "ref", "left")
    code = F.when(F.col("type") != "way", "not-a-way").when(~F.col("role").isin("outer", "inner"), "role").when(F.col("line").isNull(), "missing-way")
    return joined.select("relation_id", "pos", "ref", "role", "line", code.alias("code"))


def helper_nodes(nodes: DataFrame, way_nodes: DataFrame, untagged: bool = False) -> DataFrame:
    """nodes(node_id, tag, ...) without the untagged ones that any way uses."""
    if untagged:
        return nodes
    used = way_nodes.select("node_id").distinct()
    plain = nodes.filter("tag is null").join(used, "node_id", "left_anti")
    return nodes.filter("tag is not null").unionByName(plain.select(*nodes.columns))


def stitch(segments: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]] | None:
    """Closed rings made of segments, turned around where needed; None if ends don't pair up."""
    rings = [s for s in segments if s[0] == s[-1] and len(s) >= 4]
    open_ = [s for s in segments if s[0] != s[-1]]
    if len(rings) + len(open_) != len(segments):
        return None
    ends: dict[tuple, list[int]] = {}
    for i, s in enumerate(open_):
        ends.setdefault(s[0], []).append(i)
        ends.setdefault(s[-1], []).append(i)
    if any(len(v) != 2 for v in ends.values()):
        return None
    left = set(range(len(open_)))
    for start in range(len(open_)):
        if start not in left:
            continue
        left.discard(start)
        ring = list(open_[start])
        while ring[0] != ring[-1]:
            following = next((i for i in ends[ring[-1]] if i in left), None)
            if following is None:
                return None
            left.discard(following)
            piece = open_[following]
            ring += (piece if piece[0] == ring[-1] else piece[::-1])[1:]
        if len(ring) < 4:
            return None
        rings.append(ring)
    return rings


def relation_rings(lines: DataFrame) -> DataFrame:
    """relation_id, role, ring_no, ring, code of relation_lines' rows; a relation with any error gives its code alone.

    A relation is one group: it holds the ways of one map object.
    """

    columns = ["relation_id", "role", "ring_no", "ring", "code"]

    def rows(relation: int, parts: list) -> list[tuple]:
        out, codes = [], [p["code"] for p in parts if p["code"] is not None]
        for role in sorted({p["role"] for p in parts}):
            rings = None if codes else stitch([[(q["x"], q["y"]) for q in p["line"]] for p in parts if p["role"] == role])
            if rings is None:
                return [(relation, None, None, None, codes[0] if codes else f"open-{role}")]
            out += [(relation, role, i, [{"x": x, "y": y} for x, y in ring], None) for i, ring in enumerate(rings)]
        return out

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for relation, parts in zip(frame["relation_id"], frame["parts"]) for r in rows(relation, list(parts))], columns=columns)

    grouped = lines.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "line", "code"))).alias("parts"))
    return grouped.mapInPandas(work, "relation_id long, role string, ring_no int, ring array<struct<x:double,y:double>>, code string")


def relation_positions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relation_id, role, ring, place, x, y of relation_lines' rows, and relation_id, code of the relations with an error.

    The rings of relation_rings, a row for each position, with the least pos of
    a ring's ways as its name: rings are put in order by rounds of joins, so
    neither a relation nor a ring is held in one task. Of several errors the
    code is that of the first member, or of the first role that isn't closed.
    """
    coded = lines.filter("code is not null").groupBy("relation_id").agg(F.min_by("code", "pos").alias("code")).checkpoint()
    good = lines.join(coded, "relation_id", "left_anti").filter("relation_id is not null and role is not null")
    rings, broken = ring_positions(good.select(F.struct("relation_id", "role").alias("of"), F.col("pos").cast("long").alias("seq"), "line"), "of")
    open_ = broken.groupBy(F.col("of.relation_id").alias("relation_id")).agg(F.concat(F.lit("open-"), F.min("of.role")).alias("code"))
    errors = coded.unionByName(open_)
    return rings.select("of.relation_id", "of.role", "ring", "place", "x", "y").join(errors, "relation_id", "left_anti"), errors


def delta_arcs(deltas: DataFrame, scale: tuple[float, float] | None = None, translate: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """arc_id, pos, x, y of deltas(arc_id, pos, x, y): running sums, scaled and moved; as they are without a scale."""
    if scale is None:
        return deltas
    line = Window.partitionBy("arc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("arc_id", "pos", *((F.sum(c).over(line) * scale[i] + translate[i]).alias(c) for i, c in enumerate("xy")))


def stitch_arcs(refs: DataFrame, arcs: DataFrame) -> DataFrame:
    """line_id, line of refs(line_id, seq, arc): arcs joined end to end; a negative number n is arc ~n turned around.

    The vertex where two arcs meet is there once; lines whose arcs don't meet are left out.
    """
    paths = arcs.groupBy("arc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("path"))
    wanted = refs.withColumn("arc_id", F.when(F.col("arc") < 0, -F.col("arc") - 1).otherwise(F.col("arc")))
    met = wanted.join(paths, "arc_id").withColumn("path", F.when(F.col("arc") < 0, F.reverse("path")).otherwise(F.col("path")))
    need = refs.groupBy("line_id").agg(F.count("*").alias("n"))
    rows = met.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("parts")).join(need, "line_id").filter(F.size("parts") == F.col("n"))
    paths_of = F.transform("parts", lambda p: p["path"])
    meets = F.forall(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.element_at(F.get(paths_of, i.cast("int")), -1) == F.get(F.get(paths_of, (i + 1).cast("int")), F.lit(0)))
    joined = F.flatten(F.transform(paths_of, lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))))
    return rows.filter((F.col("n") == 1) | meets).select("line_id", joined.alias("line"))


def topology_lines(files: DataFrame) -> DataFrame:
    """source, object, place, line of the LineString objects of topologies files(source, v): their arcs joined.

    Arcs are decoded with the topology's transform, if it has one.
    """
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    read = files.select("source", get("$.arcs", "array<array<array<double>>>").alias("arcs"), F.coalesce(get("$.transform.scale", "array<double>"), F.array(F.lit(1.0), F.lit(1.0))).alias("k"), F.coalesce(get("$.transform.translate", "array<double>"), F.array(F.lit(0.0), F.lit(0.0))).alias("t"), get("$.transform", "variant").isNotNull().alias("delta"), get("$.objects", "map<string,variant>").alias("objects"))
    flat = read.select("source", "k", "t", "delta", F.posexplode("arcs").alias("arc_id", "path")).select("source", "k", "t", "delta", "arc_id", F.posexplode("path").alias("pos", "p"))
    line = Window.partitionBy("source", "arc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda i: F.when(F.col("delta"), F.sum(F.col("p")[i]).over(line) * F.col("k")[i] + F.col("t")[i]).otherwise(F.col("p")[i])
    key = lambda n: F.concat("source", F.lit("\n"), F.col(n).cast("string"))
    arcs = flat.select(key("arc_id").alias("arc_key"), "pos", at(0).alias("x"), at(1).alias("y"))
    paths = arcs.groupBy("arc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("path"))
    members = read.select("source", F.explode("objects").alias("object", "o")).withColumn("kind", F.try_variant_get("o", "$.type", "string"))
    single = members.filter("kind = 'LineString'").select("source", "object", F.lit(0).alias("place"), "o")
    several = members.filter("kind = 'GeometryCollection'").select("source", "object", F.posexplode(F.try_variant_get("o", "$.geometries", "array<variant>")).alias("place", "o"))
    refs = single.unionByName(several).select("source", "object", "place", F.posexplode(F.try_variant_get("o", "$.arcs", "array<bigint>")).alias("seq", "arc"))
    refs = refs.withColumn("own", F.when(F.col("arc") < 0, -F.col("arc") - 1).otherwise(F.col("arc"))).withColumn("arc_key", key("own"))
    met = refs.join(paths, "arc_key").withColumn("path", F.when(F.col("arc") < 0, F.reverse("path")).otherwise(F.col("path")))
    rows = met.groupBy("source", "object", "place").agg(F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["path"]).otherwise(F.slice(p["path"], 2, F.greatest(F.size(p["path"]) - 1, F.lit(0))))))
    return rows.select("source", "object", "place", joined.alias("line"))
