"""Style layers over features: what each layer draws, groups that a layer can't tell apart, and what is hit.

Features have feature_id, feature_seq, source_layer, geometry_type, parts and
props (VARIANT); a column state (VARIANT) may be there. Layers are dicts as in
style documents: id, type, source-layer, filter, minzoom, maxzoom, layout,
paint. Their place in the list is their order, the last on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.expressions import Row, Value, compile_expression, compile_filter, is_legacy, legacy_function, member
from .spatial import answered, asked_once, features_at_places

#: The kinds of geometry (1 points, 2 lines, 3 polygons) that a layer type draws.
KINDS = {"heatmap": (1,), "circle": (1,), "symbol": (1, 2, 3), "fill": (3,), "fill-extrusion": (3,), "line": (2,)}
#: Layer type -> column -> property, default, least and greatest value.
NUMBERS = {
    "heatmap": {"radius": ("heatmap-radius", 30.0, 0.0, 256.0), "opacity": ("heatmap-opacity", 1.0, 0.0, 1.0)},
    "circle": {"radius": ("circle-radius", 5.0, 0.0, None), "opacity": ("circle-opacity", 1.0, 0.0, 1.0), "stroke": ("circle-stroke-width", 0.0, 0.0, None), "stroke_opacity": ("circle-stroke-opacity", 1.0, 0.0, 1.0)},
    "symbol": {"size": ("text-size", 16.0, 0.0, None), "opacity": ("text-opacity", 1.0, 0.0, 1.0)},
    "fill": {"opacity": ("fill-opacity", 1.0, 0.0, 1.0)},
    "fill-extrusion": {"opacity": ("fill-extrusion-opacity", 1.0, 0.0, 1.0)},
    "line": {"width": ("line-width", 1.0, 0.0, None), "opacity": ("line-opacity", 1.0, 0.0, 1.0)},
}
#: Layer type -> property of the color.
COLORS = {"circle": "circle-color", "symbol": "text-color", "fill": "fill-color", "fill-extrusion": "fill-extrusion-color", "line": "line-color"}
#: The greatest finite number.
MOST = 1.7976931348623157e308
PAINT = ["color", "opacity", "width", "radius", "stroke", "stroke_opacity", "size"]


def reads(e: object) -> set[tuple[str, str]]:
    """What an expression or filter reads of a feature: ("get", name), or ("id", ""), ("geometry-type", ""), ("feature-state", ""), ("properties", "")."""
    if isinstance(e, dict):
        return reads(legacy_function(e)) if "stops" in e else set()
    if not isinstance(e, list) or not e or e[0] == "literal":
        return set()
    op, args = e[0], e[1:]
    if is_legacy(e):
        if op in ("all", "any", "none"):
            return set().union(*map(reads, args))
        return {{"$type": ("geometry-type", ""), "$id": ("id", "")}.get(args[0], ("get", args[0]))}
    if op in ("id", "geometry-type", "properties", "feature-state"):
        return {(op, "")}
    if op in ("get", "has", "!has"):
        return reads(args[1]) if len(args) > 1 else {("get", args[0])}
    if op == "match":  # labels are no expressions
        args = [args[0], *args[2:-1:2], args[-1]]
    elif op.startswith("interpolate"):
        args = args[1:]
    return set().union(*map(reads, args)) if args else set()


def paint_of(layer: dict) -> dict[str, object]:
    """The layer's layout and paint by property; older functions as expressions."""
    both = {**layer.get("layout", {}), **layer.get("paint", {})}
    return {k: legacy_function(v) if isinstance(v, dict) and "stops" in v else v for k, v in both.items()}


def layer_reads(layer: dict) -> list[tuple[str, str]]:
    """What the layer's paint reads, in order; its texts, icons and sort keys are each feature's own."""
    own = {"text-field", "icon-image", "symbol-sort-key"}
    return sorted(set().union(*(reads(e) for name, e in paint_of(layer).items() if name not in own)))


def shown(layer: dict, zoom: float) -> bool:
    """Visible, from minzoom on and below maxzoom."""
    return layer.get("layout", {}).get("visibility", "visible") != "none" and layer.get("minzoom", 0) <= zoom < layer.get("maxzoom", 24)


def instruction(layer: dict, row: Row) -> Column:
    """A struct of PAINT; values that are no numbers are the default, null what the layer type hasn't."""
    paint = paint_of(layer)
    color, default = paint.get(COLORS.get(layer["type"])), F.lit("#000000")
    columns = {"color": F.coalesce(compile_expression(color, row).str, default) if color is not None else default}
    for name in PAINT[1:]:
        if name not in NUMBERS[layer["type"]]:
            columns[name] = F.lit(None).cast("double")
            continue
        key, default, low, high = NUMBERS[layer["type"]][name]
        columns[name] = F.lit(default)
        if key in paint:
            n = finite(compile_expression(paint[key], row))
            n = F.greatest(F.coalesce(n, F.lit(default)), F.lit(low))
            columns[name] = F.least(n, F.lit(high)) if high is not None else n
    return F.struct(*(columns[c].alias(c) for c in PAINT))


def finite(v: Value) -> Column:
    """The number that a value counts as; null if it is none, not finite, or not there. Each slot is named once: expressions are deep."""
    n = F.coalesce(v.num, v.bool.cast("double"), F.trim(v.str).try_cast("double"))
    return F.when(F.abs(n) <= MOST, n)


def row_of(features: DataFrame, zoom: float) -> Row:
    return Row(F.col("props"), F.col("feature_id"), F.col("geometry_type"), zoom, F.col("state") if "state" in features.columns else None)


def drawn_by(layer: dict, row: Row) -> Column:
    """Whether a layer draws a feature: its source layer, its kind of geometry and its filter agree."""
    source = layer.get("source-layer")
    named = F.lit(True) if source is None else F.col("source_layer").eqNullSafe(F.lit(source))
    kind = F.coalesce(geo.geom_kind(F.col("geometry_type")).isin(*KINDS[layer["type"]]), F.lit(False))
    return named & kind & compile_filter(layer.get("filter"), row)


def with_layers(features: DataFrame, layers: list[dict], zoom: float, value) -> DataFrame:
    """features with layer, place and value(layer, row), a row for each layer that draws a feature at the zoom.

    All layers are tested in one pass without a shuffle: a feature gets an
    array of those that draw it, which is exploded. Layers that aren't shown,
    and types without features such as backgrounds, give no rows; nor do
    features without a known type of geometry.
    """
    row = row_of(features, zoom)
    drawn = [(place, layer) for place, layer in enumerate(layers) if layer["type"] in KINDS and shown(layer, zoom)]
    if not drawn:
        drawn, features = [(0, {"id": "", "type": "line"})], features.filter(F.lit(False))
    each = [F.when(drawn_by(layer, row), F.struct(F.lit(layer["id"]).alias("layer"), F.lit(layer["type"]).alias("type"), F.lit(place).alias("place"), value(layer, row).alias("value"))) for place, layer in drawn]
    # the array is a column of its own: a generator's operand isn't compiled
    rows = features.withColumn("_all", F.filter(F.array(*each), lambda h: h.isNotNull())).withColumn("_hit", F.explode("_all"))
    return rows.select(*features.columns, "_hit.layer", "_hit.type", "_hit.place", "_hit.value")


def painted(paint: Column) -> Column:
    """Whether anything is to be seen: an opacity over 0, or a circle's stroke."""
    stroke = F.coalesce((paint["stroke"] > 0) & (paint["stroke_opacity"] > 0), F.lit(False))
    return (paint["opacity"] > 0) | stroke


def resolve_style(features: DataFrame, layers: list[dict], zoom: float) -> DataFrame:
    """features with layer, type, place, and the PAINT of each layer that draws them at the zoom; nothing is shuffled."""
    return with_layers(features, layers, zoom, instruction).select(*features.columns, "layer", "type", "place", *(F.col("value")[c].alias(c) for c in PAINT))


def seen(layer: dict, row: Row) -> Column:
    """What a layer's paint reads of a feature, as JSON text: values of different types differ, and absent ones are absent."""
    parts = []
    for op, name in layer_reads(layer):
        if op == "get" and row.props is not None:
            text = F.to_json(member(row.props, name))
            parts.append(F.struct(F.lit("." + name).alias("name"), text.alias("text")))
        elif op == "properties" and row.props is not None:
            parts.append(F.struct(F.lit("properties").alias("name"), F.to_json(row.props).alias("text")))
        elif op == "feature-state" and row.state is not None:
            parts.append(F.struct(F.lit("state").alias("name"), F.to_json(row.state).alias("text")))
        elif op == "id" and row.fid is not None:
            parts.append(F.struct(F.lit("id").alias("name"), row.fid.cast("string").alias("text")))
        elif op == "geometry-type":
            parts.append(F.struct(F.lit("type").alias("name"), row.geometry_type.alias("text")))
    if not parts:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*parts), lambda p: p["text"].isNotNull()))


def style_members(features: DataFrame, layers: list[dict], zoom: float) -> DataFrame:
    """feature_id, feature_seq, layer, place, seen: the group of each feature in each layer that draws it; nothing is shuffled."""
    rows = with_layers(features, layers, zoom, seen)
    return rows.select("feature_id", "feature_seq", "layer", "place", F.to_json("value").alias("seen"))


def style_groups(members: DataFrame, layers: list[dict], zoom: float) -> DataFrame:
    """layer, place, seen, n and PAINT of style_members' groups: those that a layer can't tell apart, evaluated once.

    Counts are combined before the shuffle, so a group may hold any share of
    the features. What is evaluated is the group's own text, so no feature is
    carried along. Properties are keyed as .name, other parts by their own.
    """
    groups = members.groupBy("layer", "place", "seen").agg(F.count("*").alias("n"))
    read = F.from_json("seen", "map<string,string>")
    props = F.filter(F.map_entries(read), lambda e: e["key"].startswith("."))
    # ["name"] without its brackets, a colon and the value's own JSON
    fields = F.transform(props, lambda e: F.concat(F.regexp_replace(F.to_json(F.array(F.substring(e["key"], 2, 1 << 30))), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    all_of = [place for place, layer in enumerate(layers) if ("properties", "") in layer_reads(layer)]
    whole = F.when(F.col("place").isin(all_of), read["properties"]).otherwise(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
    groups = groups.withColumn("_props", F.try_parse_json(whole)).withColumn("_id", read["id"]).withColumn("_type", read["type"]).withColumn("_state", F.try_parse_json(read["state"]))
    row = Row(F.col("_props"), F.col("_id"), F.col("_type"), zoom, F.col("_state"))
    nothing = F.lit(None).cast("struct<" + ",".join(f"{c}:{'string' if c == 'color' else 'double'}" for c in PAINT) + ">")
    each = F.coalesce(*(F.when(F.col("place") == place, instruction(layer, row)) for place, layer in enumerate(layers) if layer["type"] in KINDS and shown(layer, zoom)), nothing)
    return groups.select("layer", "place", "seen", "n", each.alias("_paint")).select("layer", "place", "seen", "n", *(F.col("_paint")[c].alias(c) for c in PAINT))


def layer_hits(points: DataFrame, features: DataFrame, layers: list[dict], zoom: float, only: list[str] | None = None, where: object = None, tolerance: float = 3.0) -> DataFrame:
    """point_id, layer, place, feature_id, feature_seq of what points(point_id, x, y) hit, each feature once a layer.

    Positions of points and parts are pixels at the zoom. Features are hit
    where they are painted and as far as their paint reaches (see features_at);
    symbols sit on a point feature's first position and in the middle of the
    box of others, extrusions cover their footprint. Heat layers are never hit.
    `only` names the layers that are asked, `where` is a filter on features.
    The tolerance is 0 to 32. Null ids and positions are hit by nothing.
    """
    places, members = asked_once(points, "point_id", ["x", "y"])
    return answered(hits_of_places(places, features, layers, zoom, only, where, tolerance), members, "point_id")


def top_layer_hits(points: DataFrame, features: DataFrame, layers: list[dict], zoom: float, most: int | None = None, only: list[str] | None = None, where: object = None, tolerance: float = 3.0) -> DataFrame:
    """ranked_hits of layer_hits: points of one position have the same, which are found and ranked once; rows of points are made last."""
    places, members = asked_once(points, "point_id", ["x", "y"])
    return answered(ranked_hits(hits_of_places(places, features, layers, zoom, only, where, tolerance), most), members, "point_id")


def hits_of_places(points: DataFrame, features: DataFrame, layers: list[dict], zoom: float, only: list[str] | None, where: object, tolerance: float) -> DataFrame:
    """layer_hits of different positions."""
    asked = [layer if layer["type"] != "heatmap" and (only is None or layer["id"] in only) else {**layer, "type": "background"} for layer in layers]
    kept = features.filter(compile_filter(where, row_of(features, zoom)) & F.col("feature_id").isNotNull())
    drawn = with_layers(kept, asked, zoom, instruction).filter(painted(F.col("value")))
    first = F.filter(F.flatten("parts"), lambda p: p["x"].isNotNull())
    point = geo.geom_kind(F.col("geometry_type")) == 1
    at = F.array(F.array(F.when(point, F.get(first, F.lit(0))).otherwise(geo.polygon_anchor(F.col("parts")))))
    parts = F.when(F.col("type") == "symbol", at).otherwise(F.col("parts"))
    kind = F.when(F.col("type") == "fill-extrusion", "fill").otherwise(F.col("type"))
    # one text names the layer and the feature, ids last: they may hold anything
    key = F.concat_ws(":", "place", F.coalesce(F.col("feature_seq").cast("string"), F.lit("")), F.col("feature_id").cast("string"))
    shapes = drawn.select(key.alias("feature_id"), kind.alias("kind"), parts.alias("parts"), *(F.col("value")[c].alias(c) for c in ("width", "radius", "stroke", "size")))
    hits = features_at_places(points, shapes, float(min(32.0, max(0.0, tolerance))))
    cut = F.split("feature_id", ":", 3)
    names = F.array(*(F.lit(layer["id"]) for layer in layers))
    found = hits.select("point_id", cut[0].cast("int").alias("place"), cut[1].try_cast("long").alias("feature_seq"), cut[2].cast(features.schema["feature_id"].dataType).alias("feature_id"))
    return found.select("point_id", F.get(names, F.col("place")).alias("layer"), "place", "feature_id", "feature_seq")


def ranked_hits(hits: DataFrame, most: int | None = None) -> DataFrame:
    """layer_hits with rank from 1 for each point: the topmost layer first, then the latest feature; `most` at most, if it is given.

    With `most`, ranks are limited before the shuffle too, so a point under
    which everything lies sends few rows; 1 is found by a maximum.
    """
    order = [F.desc("place"), F.desc("feature_seq"), F.desc("feature_id")]
    if most == 1:
        best = hits.groupBy("point_id").agg(F.max(F.struct("place", "feature_seq", "feature_id", "layer")).alias("top"))
        return best.select("point_id", "top.layer", "top.place", "top.feature_id", "top.feature_seq", F.lit(1).cast("long").alias("rank"))
    rows = hits.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy(*order)).cast("long"))
    return rows if most is None else rows.filter(F.col("rank") <= most)
