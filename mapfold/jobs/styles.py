"""Style expressions and filters over the events' properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Row, compile_expression, compile_filter, fill_tokens, legacy_function
from .inputs import scaled, table
from .registry import query

K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
CASED = "event_type"


def rows(spark: SparkSession, d: str) -> tuple[DataFrame, Row]:
    """Events with props {"k": n, "type": event_type, "v": value or absent, "name": text or null}."""
    e = table(spark, d, "events")
    props = F.parse_json(F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "type": "'), "event_type", F.lit('", "name": '), F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"n'), F.col("event_id") % 10, F.lit('"'))), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(', "v": '), F.col("user_id").cast("string"))), F.lit("}")))
    e = e.select("event_id", props.alias("p"))
    return e, Row(props=e["p"], fid=e["event_id"], geometry_type=F.when(e["event_id"] % 2 == 0, "Point").otherwise("MultiLineString"), zoom=10)


def ask(spark: SparkSession, d: str, **columns) -> DataFrame:
    """columns: name to (expression, slot)."""
    e, row = rows(spark, d)
    picked = []
    for name, (expression, slot) in columns.items():
        v = compile_expression(expression, row)
        picked.append((scaled(v.num) if slot == "num" else v.text() if slot == "text" else getattr(v, slot)).alias(name))
    return e.select("event_id", *picked)


E = f"(SELECT event_id, {K} AS k, event_type AS t, CASE WHEN event_id % 3 <> 0 THEN 'n' || (event_id % 10) END AS name, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS DOUBLE) END AS v FROM events)"
M = "CAST(floor(({}) * 1000 + 0.5) AS BIGINT)"


@query(f"SELECT event_id, {M.format('k')} AS k, event_id % 4 <> 0 AS has_v, true AS has_name, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind, {M.format('10')} AS zoom FROM {E}")
def ex_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, k=(["get", "k"], "num"), has_v=(["has", "v"], "bool"), has_name=(["has", "name"], "bool"), id=(["id"], "text"), kind=(["geometry-type"], "text"), zoom=(["zoom"], "num"))


@query(f"SELECT event_id, {M.format('k * 2 + 1')} AS y FROM {E}")
def ex_bind(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, y=(["let", "a", ["*", ["get", "k"], 2], "b", 1, ["+", ["var", "a"], ["var", "b"]]], "num"))


@query(f"""SELECT event_id, coalesce(name, t) AS first, CASE WHEN k > 50 THEN 'high' WHEN v < 20 THEN 'low v' ELSE 'low' END AS cased,
CASE WHEN t IN ('view', 'click') THEN 'light' WHEN t = 'purchase' THEN 'heavy' ELSE 'other' END AS matched, CASE WHEN v >= 100 THEN 'c' WHEN v >= 50 THEN 'b' ELSE 'a' END AS stepped FROM {E}""")
def ex_branch(spark: SparkSession, d: str) -> DataFrame:
    return ask(
        spark, d,
        first=(["coalesce", ["get", "name"], ["get", "type"]], "text"),
        cased=(["case", [">", ["get", "k"], 50], "high", ["<", ["get", "v"], 20], "low v", "low"], "text"),
        matched=(["match", ["get", "type"], ["view", "click"], "light", "purchase", "heavy", "other"], "text"),
        stepped=(["step", ["get", "v"], "a", 50, "b", 100, "c"], "text"),
    )


CHANNEL = "CAST(CAST(floor({} + 0.5) AS BIGINT) AS VARCHAR)"


@query(f"""SELECT event_id, {M.format('CASE WHEN k <= 10 THEN 1 WHEN k < 50 THEN 1 + (k - 10) / 40 * 9 WHEN k < 90 THEN 10 + (pow(1, 0) * (k - 50) / 40) * 20 ELSE 30 END')} AS size,
{M.format('CASE WHEN k <= 0 THEN 0 WHEN k < 100 THEN 100 * (pow(1.02e0, k) - 1) / (pow(1.02e0, 100) - 1) ELSE 100 END')} AS grown,
CASE WHEN v IS NOT NULL THEN 'rgba(' || {CHANNEL.format('greatest(0, least(100, v)) / 100 * 255')} || ',0,' || {CHANNEL.format('255 - greatest(0, least(100, v)) / 100 * 255')} || ',1)' END AS color FROM {E}""")
def ex_interp(spark: SparkSession, d: str) -> DataFrame:
    rows = ask(
        spark, d,
        size=(["interpolate", ["linear"], ["get", "k"], 10, 1, 50, 10, 90, 30], "num"),
        grown=(["interpolate", ["exponential", 1.02], ["get", "k"], 0, 0, 100, 100], "num"),
        color=(["interpolate", ["linear"], ["get", "v"], 0, "blue", 100, "#f00"], "str"),
    )
    return rows


@query(f"""SELECT event_id, {M.format('2 * least(greatest(k, 0), 100) / 100')} AS x, {M.format('10 - 20 * least(greatest(k, 0), 100) / 100')} AS y, CASE WHEN k < 50 THEN 'left' ELSE 'right' END AS side FROM {E}""")
def ex_interp_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Items of arrays between stops: numbers blend, others snap at the middle."""
    ramp = ["interpolate", ["linear"], ["get", "k"], 0, ["literal", [0, 10, "left"]], 100, ["literal", [2, -10, "right"]]]
    return ask(spark, d, x=(["at", 0, ramp], "num"), y=(["at", 1, ramp], "num"), side=(["at", 2, ramp], "str"))


@query(f"""SELECT event_id, t = 'view' AS is_view, v IS NULL OR v <> 7 AS not_7, coalesce(v < 50, false) AS below, coalesce(name > 'n5', false) AS later, t IN ('view', 'signup') AND k > 20 AS both, contains(t, 'i') AS has_i, false AS mixed FROM {E}""")
def ex_compare(spark: SparkSession, d: str) -> DataFrame:
    return ask(
        spark, d,
        is_view=(["==", ["get", "type"], "view"], "bool"), not_7=(["!=", ["get", "v"], 7], "bool"), below=(["<", ["get", "v"], 50], "bool"), later=([">", ["get", "name"], "n5"], "bool"),
        both=(["all", ["in", ["get", "type"], ["literal", ["view", "signup"]]], [">", ["get", "k"], 20]], "bool"), has_i=(["in", "i", ["get", "type"]], "bool"), mixed=(["<", ["get", "k"], ["get", "type"]], "bool"),
    )


@query(f"SELECT event_id, {M.format('k')} AS number, t AS string, CASE WHEN name IS NULL THEN 'null' ELSE 'string' END AS kind, CASE WHEN v IS NULL THEN 'null' ELSE 'number' END AS kind_v FROM {E}")
def ex_assert(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, number=(["number", ["get", "type"], ["get", "k"]], "num"), string=(["string", ["get", "k"], ["get", "type"]], "str"), kind=(["typeof", ["get", "name"]], "text"), kind_v=(["typeof", ["get", "v"]], "text"))


@query(f"SELECT event_id, {M.format('coalesce(v, 0)')} AS n, CASE WHEN v IS NULL THEN '' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS s, coalesce(v <> 0, false) AS b, {M.format('12.5')} AS parsed FROM {E}")
def ex_convert(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, n=(["to-number", ["get", "v"]], "num"), s=(["to-string", ["get", "v"]], "text"), b=(["to-boolean", ["get", "v"]], "bool"), parsed=(["to-number", " 12.5 "], "num"))


@query(f"""SELECT event_id, t || '/' || coalesce(name, '') || '/' || CAST(CAST(k AS BIGINT) AS VARCHAR) AS label, upper(t) AS loud, {M.format('length(t)')} AS n, substr(t, 2, 3) AS mid, right(t, 2) AS tail,
{M.format("instr(t, 'i') - 1")} AS at, 'x ' || t || '!' AS tokens FROM {E}""")
def ex_string(spark: SparkSession, d: str) -> DataFrame:
    return ask(
        spark, d,
        label=(["concat", ["get", "type"], "/", ["get", "name"], "/", ["get", "k"]], "text"), loud=(["upcase", ["get", "type"]], "text"), n=(["length", ["get", "type"]], "num"),
        mid=(["slice", ["get", "type"], 1, 4], "text"), tail=(["slice", ["get", "type"], -2], "text"), at=(["index-of", "i", ["get", "type"]], "num"), tokens=(fill_tokens("x {type}!"), "text"),
    )


@query(f"""SELECT event_id, {M.format('k + v * 2')} AS sum, {M.format('CASE WHEN v <> 0 THEN k / v END')} AS ratio, {M.format('k % 7')} AS rest, {M.format('sqrt(k) + sin(k)')} AS curve, {M.format('CASE WHEN v IS NULL THEN NULL ELSE least(k, v) END')} AS low, {M.format('floor(k / 2 + 0.5)')} AS rounded FROM {E}""")
def ex_math(spark: SparkSession, d: str) -> DataFrame:
    return ask(
        spark, d,
        sum=(["+", ["get", "k"], ["*", ["get", "v"], 2]], "num"), ratio=(["case", ["!=", ["get", "v"], 0], ["/", ["get", "k"], ["get", "v"]], ["literal", None]], "num"), rest=(["%", ["get", "k"], 7], "num"),
        curve=(["+", ["sqrt", ["get", "k"]], ["sin", ["get", "k"]]], "num"), low=(["min", ["get", "k"], ["get", "v"]], "num"), rounded=(["round", ["/", ["get", "k"], 2]], "num"),
    )


@query(f"SELECT event_id, CASE CAST(k AS BIGINT) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS item, {M.format('''CASE t WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END''')} AS place FROM {E}")
def ex_array(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, item=(["at", ["%", ["get", "k"], 4], ["literal", ["a", "b", "c"]]], "str"), place=(["index-of", ["get", "type"], ["literal", ["view", "click"]]], "num"))


@query(f"SELECT event_id, 'rgba(' || CAST(CAST(least(255, k * 3) AS BIGINT) AS VARCHAR) || ',0,255,0.5)' AS c FROM {E}")
def ex_color(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, c=(["rgba", ["*", ["get", "k"], 3], -5, 300, 0.5], "str"))


@query(f"""SELECT event_id, {M.format('CASE WHEN v IS NULL THEN -1 WHEN v <= 0 THEN 2 WHEN v < 100 THEN 2 + v / 10 ELSE 12 END')} AS size, CASE WHEN k >= 60 THEN 'big' ELSE 'small' END AS word, CASE t WHEN 'view' THEN 'eye' ELSE 'dot' END AS icon FROM {E}""")
def ex_legacy_fn(spark: SparkSession, d: str) -> DataFrame:
    return ask(
        spark, d,
        size=(legacy_function({"property": "v", "stops": [[0, 2], [100, 12]], "default": -1}), "num"),
        word=(legacy_function({"property": "k", "stops": [[0, "small"], [60, "big"]]}), "text"),
        icon=(legacy_function({"property": "type", "type": "categorical", "stops": [["view", "eye"]], "default": "dot"}), "text"),
    )


@query(f"SELECT event_id, {M.format('0')} AS progress, true AS script FROM {E}")
def ex_noop(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, progress=(["line-progress"], "num"), script=(["is-supported-script", "x"], "bool"))


def passing(spark: SparkSession, d: str, f: object) -> DataFrame:
    e, row = rows(spark, d)
    return e.filter(compile_filter(f, row)).select("event_id")


@query(f"SELECT event_id FROM {E} WHERE (k > 30 AND t <> 'view') OR (v IS NOT NULL AND v < 10)")
def flt_expr(spark: SparkSession, d: str) -> DataFrame:
    return passing(spark, d, ["any", ["all", [">", ["get", "k"], 30], ["!=", ["get", "type"], "view"]], ["<", ["get", "v"], 10]])


@query(f"SELECT event_id FROM {E} WHERE event_id % 2 = 0 AND t IN ('click', 'view') AND (v IS NULL OR v <> 5) AND v IS NOT NULL AND NOT (k < 20)")
def flt_legacy(spark: SparkSession, d: str) -> DataFrame:
    return passing(spark, d, ["all", ["==", "$type", "Point"], ["in", "type", "click", "view"], ["!=", "v", 5], ["has", "v"], ["none", ["<", "k", 20]]])


@query(f"SELECT event_id FROM {E} WHERE NOT (t IN ('view', 'signup')) AND v IS NULL AND event_id % 2 = 0")
def flt_overlay(spark: SparkSession, d: str) -> DataFrame:
    return passing(spark, d, ["all", ["!in", "type", "view", "signup"], ["!has", "v"], ["==", "$type", "Point"]])


#: id, source layer, kind that it draws, filter, minzoom, maxzoom, radius
LAYERS = [("dots", "click", None, 0, 24, ["get", "k"]), ("big", "purchase", [">", ["get", "k"], 50], 5, 12, ["interpolate", ["linear"], ["get", "k"], 50, 1, 100, 11]), ("far", "view", None, 11, 24, 3), ("odd", "view", ["!", ["has", "v"]], 0, 11, 7)]


def resolve_style(features: DataFrame, row: Row, layers: list, zoom: float, layer_of: str) -> DataFrame:
    """event_id, layer, place (of the layer) and radius for each layer that draws a feature at the zoom.

    All layers are tested in one pass: a feature gets an array of those that
    draw it, which is then exploded.
    """
    drawn = []
    for place, (name, source_layer, rule, low, high, radius) in enumerate(layers):
        if low <= zoom < high:
            size = compile_expression(radius, row).num
            drawn.append(F.when((F.col(layer_of) == source_layer) & compile_filter(rule, row), F.struct(F.lit(name).alias("layer"), F.lit(place).alias("place"), F.greatest(F.lit(0.0), size).alias("radius"))))
    rows = features.withColumn("hit", F.explode(F.filter(F.array(*drawn), lambda h: h.isNotNull())))
    return rows.select("event_id", "hit.layer", "hit.place", "hit.radius")


@query(f"""SELECT event_id, 'dots' AS layer, {M.format('k')} AS radius FROM {E} WHERE t = 'click' UNION ALL
SELECT event_id, 'big', {M.format('1 + (k - 50) / 50 * 10')} FROM {E} WHERE t = 'purchase' AND k > 50 UNION ALL SELECT event_id, 'odd', {M.format('7')} FROM {E} WHERE t = 'view' AND v IS NULL""")
def join_style_resolve(spark: SparkSession, d: str) -> DataFrame:
    e, row = rows(spark, d)
    e = e.withColumn("t", F.try_variant_get("p", "$.type", "string"))
    return resolve_style(e, row, LAYERS, 10, "t").select("event_id", "layer", scaled(F.col("radius")).alias("radius"))


@query(f"""SELECT layer, radius, count(*) AS n FROM (SELECT 'dots' AS layer, {M.format('k')} AS radius FROM {E} WHERE t = 'click' UNION ALL
SELECT 'big', {M.format('1 + (k - 50) / 50 * 10')} FROM {E} WHERE t = 'purchase' AND k > 50 UNION ALL SELECT 'odd', {M.format('7')} FROM {E} WHERE t = 'view' AND v IS NULL) GROUP BY layer, radius""")
def agg_style_groups(spark: SparkSession, d: str) -> DataFrame:
    """Features that a layer draws alike, as groups."""
    return join_style_resolve(spark, d).groupBy("layer", "radius").agg(F.count("*").alias("n"))
