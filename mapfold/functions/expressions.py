"""Style expressions and filters, compiled to Columns.

Values are typed at run time, as in the styles' own language: a compiled value
has a slot for each type (number, string, boolean, other JSON as text), of which
at most one is not null; null in all slots is null. Strict equality is then
equality of slots, and an operand of a wrong type is a null slot.

    compiled = compile_expression(["+", ["get", "k"], 1], Row(props=F.col("props")))
    df.select(compiled.num)
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")
#: The operators that tell an expression from a legacy filter of the same name.
LEGACY = {"==", "!=", "<", "<=", ">", ">=", "in", "!in", "has", "!has", "all", "any", "none"}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Value:
    num: Column = field(default_factory=lambda: _null("double"))
    str: Column = field(default_factory=lambda: _null("string"))
    bool: Column = field(default_factory=lambda: _null("boolean"))
    json: Column = field(default_factory=lambda: _null("string"))
    #: a literal array, object or scalar, where it is known
    known: object = None

    def slots(self) -> list[Column]:
        return [self.num, self.str, self.bool, self.json]

    def is_null(self) -> Column:
        return self.num.isNull() & self.str.isNull() & self.bool.isNull() & self.json.isNull()

    def true(self) -> Column:
        return F.coalesce(self.bool, F.lit(False))

    def text(self) -> Column:
        """As the styles' language writes it; null as empty text."""
        return F.coalesce(self.str, number_text(self.num), self.bool.cast("string"), self.json, F.lit(""))


def number_text(n: Column) -> Column:
    """1 for 1.0, 1.5 for 1.5."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(n.isNull(), None).when(F.isnan(n), "NaN").when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))


def literal(v: object) -> Value:
    if v is None:
        return Value()
    if isinstance(v, bool):
        return Value(bool=F.lit(v), known=v)
    if isinstance(v, (int, float)):
        return Value(num=F.lit(float(v)), known=v)
    if isinstance(v, str):
        return Value(str=F.lit(v), known=v)
    return Value(json=F.lit(json.dumps(v, separators=(",", ":"), ensure_ascii=False)), known=v)


@dataclass
class Row:
    """Where a feature's parts are: props and state are VARIANT columns."""

    props: Column | None = None
    fid: Column | None = None
    geometry_type: Column | None = None
    zoom: Column | float = 0.0
    state: Column | None = None


def of_variant(v: Column) -> Value:
    kind = F.schema_of_variant(v)
    number = kind.isin(*NUMBERS) | kind.startswith("DECIMAL")
    other = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return Value(
        num=F.when(number, F.try_variant_get(v, "$", "double")),
        str=F.when(kind == "STRING", F.try_variant_get(v, "$", "string")),
        bool=F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        json=F.when(other, F.to_json(v)),
    )


def member(v: Column, key: str) -> Column:
    """A property by name; paths have no escapes, so names with both quotes, and the empty name, are looked up in a map."""
    sign = next((q for q in "\"'" if q not in key), None)
    if not key or sign is None:
        return F.try_variant_get(v, "$", "map<string,variant>")[key]
    return F.try_variant_get(v, f"$[{sign}{key}{sign}]", "variant")


def choose(pairs: list[tuple[Column, Value]], other: Value) -> Value:
    out = []
    for i in range(4):
        col = other.slots()[i]
        for condition, value in reversed(pairs):
            col = F.when(condition, value.slots()[i]).otherwise(col)
        out.append(col)
    return Value(*out)


def equal(a: Value, b: Value) -> Column:
    same = F.lit(True)
    for x, y in zip(a.slots(), b.slots()):
        same = same & x.eqNullSafe(y)
    return same


def ordered(op: str, a: Value, b: Value) -> Column:
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    both = ~F.isnan(a.num) & ~F.isnan(b.num)
    return F.coalesce(both & compare(a.num, b.num), compare(a.str, b.str), F.lit(False))


def truthy(v: Value) -> Column:
    return F.coalesce(v.bool, (v.num != 0) & ~F.isnan(v.num), F.length(v.str) > 0, v.json.isNotNull())


def type_name(v: Value) -> Column:
    return F.when(v.num.isNotNull(), "number").when(v.str.isNotNull(), "string").when(v.bool.isNotNull(), "boolean").when(v.json.startswith("["), "array").when(v.json.isNotNull(), "object").otherwise("null")


def to_number(v: Value) -> Value:
    text = F.trim(v.str)
    return Value(num=F.when(v.num.isNotNull(), v.num).when(v.bool.isNotNull(), v.bool.cast("double")).when(v.is_null(), 0.0).when(F.length(text) > 0, text.try_cast("double")))


def divide(a: Column, b: Column) -> Column:
    """x/0 is an infinity or not a number, as in floating-point arithmetic."""
    return F.when(a.isNull() | b.isNull(), None).when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))


def round_away(n: Column) -> Column:
    return F.signum(n) * F.floor(F.abs(n) + 0.5)


def log(n: Column) -> Column:
    return F.when(n > 0, F.log(n)).when(n == 0, float("-inf")).when(n.isNotNull(), float("nan"))


UNARY = {
    "round": round_away, "floor": lambda n: F.floor(n).cast("double"), "ceil": lambda n: F.ceil(n).cast("double"), "abs": F.abs, "sqrt": F.sqrt,
    "ln": log, "log10": lambda n: log(n) / math.log(10), "log2": lambda n: log(n) / math.log(2),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
}
# The colours that style sheets name, with their red, green and blue in two hexadecimal digits each.
COLOURS = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00
chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b
darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b
darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f
darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493
deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22
fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f
grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa
lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff
lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a
lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de
lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa
mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee
mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa
mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500
orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093
papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080
rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460
seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090
slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347
turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
NAMED = {name: (*bytes.fromhex(digits), 1) for name, digits in zip(COLOURS[::2], COLOURS[1::2])} | {"transparent": (0, 0, 0, 0)}


def parse_color(text: str) -> tuple[float, float, float, float] | None:
    """r, g, b (0 to 255) and alpha (0 to 1) of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba(), hsl(), hsla() and names."""
    text = text.strip().lower()
    if text in NAMED:
        return NAMED[text]
    if text.startswith("#"):
        digits = text[1:]
        if len(digits) in (3, 4):
            digits = "".join(c + c for c in digits)
        if len(digits) not in (6, 8):
            return None
        try:
            values = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
        except ValueError:
            return None
        return (*values[:3], values[3] / 255 if len(values) == 4 else 1)
    name, _, rest = text.partition("(")
    parts = rest.rstrip(")").replace(",", " ").replace("/", " ").split()
    if name not in ("rgb", "rgba", "hsl", "hsla") or len(parts) not in (3, 4):
        return None
    try:
        alpha = 1.0 if len(parts) == 3 else float(parts[3].rstrip("%")) / (100 if parts[3].endswith("%") else 1)
        if name.startswith("rgb"):
            return (*(float(p.rstrip("%")) * (2.55 if p.endswith("%") else 1) for p in parts[:3]), alpha)
        hue, s, light = float(parts[0].removesuffix("deg")) % 360, float(parts[1].rstrip("%")) / 100, float(parts[2].rstrip("%")) / 100
    except ValueError:
        return None
    import colorsys

    return (*(c * 255 for c in colorsys.hls_to_rgb(hue / 360, light, s)), alpha)


def rgba_text(r: Column, g: Column, b: Column, a: Column) -> Column:
    channel = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + 0.5).cast("string")
    alpha = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)) * 1000 + 0.5) / 1000
    return F.concat(F.lit("rgba("), channel(r), F.lit(","), channel(g), F.lit(","), channel(b), F.lit(","), number_text(alpha), F.lit(")"))


def mix(a: Value, b: Value, t: Column) -> Value:
    """Between two outputs of a ramp: numbers and colours blend, known arrays of one length do so item by item, others snap at the middle."""
    if isinstance(a.known, list) and isinstance(b.known, list) and len(a.known) == len(b.known):
        items = [item_text(mix(literal(x), literal(y), t)) for x, y in zip(a.known, b.known)]
        return Value(json=F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")))
    ca, cb = (parse_color(v.known) if isinstance(v.known, str) else None for v in (a, b))
    if ca and cb:
        return Value(str=rgba_text(*(F.lit(float(x)) + (float(y) - float(x)) * t for x, y in zip(ca, cb))))
    snapped = choose([(t < 0.5, a)], b)
    return replace(snapped, num=F.coalesce(a.num + (b.num - a.num) * t, snapped.num))


def item_text(v: Value) -> Column:
    """A value as an item of a JSON array."""
    quoted = F.regexp_replace(F.to_json(F.array(v.str)), r"^\[|\]$", "")
    return F.coalesce(F.when(v.str.isNotNull(), quoted), number_text(v.num), v.bool.cast("string"), v.json, F.lit("null"))


class Compiler:
    def __init__(self, row: Row, strict: bool = True):
        self.row, self.strict, self.names = row, strict, {}

    def __call__(self, e: object) -> Value:
        if not isinstance(e, list):
            return literal(e)
        if not e or not isinstance(e[0], str):
            raise ValueError(f"not an expression: {e!r}")
        op, args = e[0], e[1:]
        if op in UNARY:
            return Value(num=UNARY[op](self(args[0]).num))
        method = METHODS.get(op)
        if method is None:
            raise ValueError(f"unknown operator {op!r}")
        return method(self, op, args)

    def key(self, args: list) -> str:
        if not args or not isinstance(args[0], str):
            raise ValueError("a property needs a name")
        return args[0]

    def get(self, op: str, args: list) -> Value:
        if len(args) > 1:
            return of_variant(member(F.try_parse_json(self(args[1]).json), self.key(args)))
        return Value() if self.row.props is None else of_variant(member(self.row.props, self.key(args)))

    def has(self, op: str, args: list) -> Value:
        v = F.try_parse_json(self(args[1]).json) if len(args) > 1 else self.row.props
        there = F.lit(False) if v is None else member(v, self.key(args)).isNotNull()
        return Value(bool=~there if op == "!has" else there)

    def state(self, op: str, args: list) -> Value:
        return Value() if self.row.state is None else of_variant(member(self.row.state, self.key(args)))

    def part(self, op: str, args: list) -> Value:
        row = self.row
        if op == "zoom":
            return Value(num=row.zoom if isinstance(row.zoom, Column) else F.lit(float(row.zoom)))
        if op == "id":
            return Value() if row.fid is None else Value(str=row.fid.cast("string"))
        if op == "geometry-type":
            return Value() if row.geometry_type is None else Value(str=F.regexp_replace(row.geometry_type, "^Multi", ""))
        return Value() if row.props is None else Value(json=F.to_json(row.props))

    def constant(self, op: str, args: list) -> Value:
        return literal({"pi": math.pi, "e": math.e, "line-progress": 0, "accumulated": None, "global-state": None, "is-supported-script": True, "collator": None, "resolved-locale": "en"}[op])

    def literal(self, op: str, args: list) -> Value:
        return literal(args[0])

    def let(self, op: str, args: list) -> Value:
        saved = dict(self.names)
        for name, value in zip(args[:-1:2], args[1:-1:2]):
            self.names[name] = self(value)
        out = self(args[-1])
        self.names = saved
        return out

    def var(self, op: str, args: list) -> Value:
        if args[0] not in self.names:
            raise ValueError(f"unknown variable {args[0]!r}")
        return self.names[args[0]]

    def coalesce(self, op: str, args: list) -> Value:
        values = [self(a) for a in args]
        return choose([(~v.is_null(), v) for v in values[:-1]], values[-1])

    def case(self, op: str, args: list) -> Value:
        return choose([(self(c).true(), self(v)) for c, v in zip(args[:-1:2], args[1:-1:2])], self(args[-1]))

    def match(self, op: str, args: list) -> Value:
        v, pairs = self(args[0]), []
        for labels, out in zip(args[1:-1:2], args[2:-1:2]):
            hit = F.lit(False)
            for label in labels if isinstance(labels, list) else [labels]:
                hit = hit | equal(v, literal(label))
            pairs.append((hit, self(out)))
        return choose(pairs, self(args[-1]))

    def step(self, op: str, args: list) -> Value:
        n, pairs = self(args[0]).num, []
        for stop, out in reversed(list(zip(args[2::2], args[3::2]))):
            pairs.append((F.coalesce((n >= float(stop)) & ~F.isnan(n), F.lit(False)), self(out)))
        return choose(pairs, self(args[1]))

    def interpolate(self, op: str, args: list) -> Value:
        kind, n = args[0], self(args[1]).num
        stops = [(float(s), self(v)) for s, v in zip(args[2::2], args[3::2])]
        if any(b[0] <= a[0] for a, b in zip(stops, stops[1:])) or not stops:
            raise ValueError("stops must ascend")
        base = float(kind[1]) if kind[0] == "exponential" else 1.0
        if base <= 0:
            raise ValueError("the base must be above 0")
        pairs = [(n <= stops[0][0], self.color(stops[0][1]))]
        for (a, va), (b, vb) in zip(stops, stops[1:]):
            t = (n - a) / (b - a) if base == 1 else (F.pow(F.lit(base), n - a) - 1) / (base ** (b - a) - 1)
            pairs.append((n < b, mix(va, vb, t)))
        return choose([(n.isNull() | F.isnan(n), Value()), *pairs], self.color(stops[-1][1]))

    def color(self, v: Value) -> Value:
        c = parse_color(v.known) if isinstance(v.known, str) else None
        return Value(str=rgba_text(*(F.lit(float(x)) for x in c))) if c else v

    def equality(self, op: str, args: list) -> Value:
        same = equal(self(args[0]), self(args[1]))
        return Value(bool=same if op == "==" else ~same)

    def order(self, op: str, args: list) -> Value:
        return Value(bool=ordered(op, self(args[0]), self(args[1])))

    def logic(self, op: str, args: list) -> Value:
        values = [self(a).true() for a in args]
        if op == "!":
            return Value(bool=~values[0])
        out = F.lit(op == "all")
        for v in values:
            out = out & v if op == "all" else out | v
        return Value(bool=out)

    def within(self, op: str, args: list) -> Value:
        needle, hay = self(args[0]), self(args[1])
        if isinstance(hay.known, list):
            hit = F.lit(False)
            for v in hay.known:
                hit = hit | equal(needle, literal(v))
        else:
            hit = F.coalesce(F.instr(hay.str, needle.str) > 0, self.place(needle, hay) >= 0, F.lit(False))
        return Value(bool=~hit if op == "!in" else hit)

    def place(self, needle: Value, hay: Value) -> Column:
        """The place of a scalar in a JSON array, or -1."""
        wanted = F.coalesce(F.when(needle.str.isNotNull(), F.to_json(F.array(needle.str))), F.concat(F.lit("["), number_text(needle.num), F.lit("]")), F.concat(F.lit("["), needle.bool.cast("string"), F.lit("]")))
        items = F.from_json(hay.json, "array<variant>")
        return F.array_position(F.transform(items, lambda v: F.to_json(F.array(v))), wanted) - 1

    def asserted(self, op: str, args: list) -> Value:
        slot = {"number": "num", "string": "str", "boolean": "bool"}.get(op)
        values = [self(a) for a in args]
        if slot:
            return Value(**{slot: F.coalesce(*(getattr(v, slot) for v in values))})
        sign = "[" if op == "array" else "{"
        return Value(json=F.coalesce(*(F.when(v.json.startswith(sign), v.json) for v in values)))

    def typeof(self, op: str, args: list) -> Value:
        return Value(str=type_name(self(args[0])))

    def convert(self, op: str, args: list) -> Value:
        values = [self(a) for a in args]
        if op == "to-number":
            return Value(num=F.coalesce(*(to_number(v).num for v in values)))
        if op == "to-boolean":
            return Value(bool=F.coalesce(truthy(values[0]), F.lit(False)))
        if op == "to-color":
            return self.color(values[0])
        return Value(str=values[0].text())

    def concat(self, op: str, args: list) -> Value:
        if op == "format":
            args = [a for a in args if not isinstance(a, dict)]
        return Value(str=F.concat(*(self(a).text() for a in args)) if args else F.lit(""))

    def case_of(self, op: str, args: list) -> Value:
        return Value(str=(F.upper if op == "upcase" else F.lower)(self(args[0]).text()))

    def length(self, op: str, args: list) -> Value:
        v = self(args[0])
        return Value(num=F.coalesce(F.length(v.str), F.json_array_length(v.json)).cast("double"))

    def slice(self, op: str, args: list) -> Value:
        v, n = self(args[0]), F.length(self(args[0]).str)
        at = lambda a: F.when(a < 0, F.greatest(F.lit(0), n + a)).otherwise(F.least(n, a)).cast("int")
        start = at(F.floor(self(args[1]).num))
        end = at(F.floor(self(args[2]).num)) if len(args) > 2 else n
        return Value(str=F.substring(v.str, start + 1, F.greatest(F.lit(0), end - start)))

    def index_of(self, op: str, args: list) -> Value:
        needle, hay = self(args[0]), self(args[1])
        start = F.greatest(F.lit(0), F.floor(self(args[2]).num).cast("int")) if len(args) > 2 else F.lit(0)
        return Value(num=F.coalesce(F.call_function("locate", needle.text(), hay.str, start + 1) - 1, self.place(needle, hay)).cast("double"))

    def at(self, op: str, args: list) -> Value:
        where, items = F.floor(self(args[0]).num).cast("int"), F.from_json(self(args[1]).json, "array<variant>")
        return of_variant(F.get(items, where))

    def number_format(self, op: str, args: list) -> Value:
        style = args[1] if len(args) > 1 else {}
        low, high = style.get("min-fraction-digits", 0), style.get("max-fraction-digits", 3)
        n = self(args[0]).num
        text = F.format_number(n, max(low, high))
        if high > low:
            text = F.regexp_replace(F.regexp_replace(text, rf"(\.\d{{{low}}}\d*?)0+$", "$1"), r"\.$", "")
        return Value(str=text)

    def sum(self, op: str, args: list) -> Value:
        values = [self(a).num for a in args]
        out = values[0]
        if op == "-" and len(values) == 1:
            return Value(num=-out)
        if op in ("min", "max"):
            pick = F.least if op == "min" else F.greatest
            some = F.lit(True)
            for v in values:
                some = some & v.isNotNull()
            return Value(num=F.when(some, pick(*values) if len(values) > 1 else out))
        for v in values[1:] if op in "+*" else values[1:2]:
            out = {"+": lambda x, y: x + y, "*": lambda x, y: x * y, "-": lambda x, y: x - y, "/": divide, "%": lambda x, y: F.when(y != 0, x % F.when(y != 0, y)).when(x.isNotNull() & y.isNotNull(), float("nan")), "^": F.pow}[op](out, v)
        return Value(num=out)

    def rgb(self, op: str, args: list) -> Value:
        r, g, b = (self(a).num for a in args[:3])
        return Value(str=rgba_text(r, g, b, self(args[3]).num if len(args) > 3 else F.lit(1.0)))


C = Compiler
METHODS = {
    "get": C.get, "has": C.has, "!has": C.has, "id": C.part, "geometry-type": C.part, "properties": C.part, "zoom": C.part, "feature-state": C.state, "literal": C.literal,
    "let": C.let, "var": C.var, "coalesce": C.coalesce, "case": C.case, "match": C.match, "step": C.step,
    "interpolate": C.interpolate, "interpolate-hcl": C.interpolate, "interpolate-lab": C.interpolate,
    "==": C.equality, "!=": C.equality, "<": C.order, "<=": C.order, ">": C.order, ">=": C.order, "!": C.logic, "all": C.logic, "any": C.logic, "in": C.within, "!in": C.within,
    "number": C.asserted, "string": C.asserted, "boolean": C.asserted, "array": C.asserted, "object": C.asserted, "typeof": C.typeof,
    "to-number": C.convert, "to-string": C.convert, "to-boolean": C.convert, "to-color": C.convert, "image": C.convert,
    "concat": C.concat, "format": C.concat, "upcase": C.case_of, "downcase": C.case_of, "length": C.length, "slice": C.slice, "index-of": C.index_of, "at": C.at, "number-format": C.number_format,
    "+": C.sum, "-": C.sum, "*": C.sum, "/": C.sum, "%": C.sum, "^": C.sum, "min": C.sum, "max": C.sum, "rgb": C.rgb, "rgba": C.rgb,
    **dict.fromkeys(("pi", "e", "line-progress", "accumulated", "global-state", "is-supported-script", "collator", "resolved-locale"), C.constant),
}


def compile_expression(e: object, row: Row) -> Value:
    return Compiler(row)(e)


def is_legacy(f: object) -> bool:
    """Whether a filter is in the older form, whose left sides are bare property names."""
    if not isinstance(f, list) or not f or f[0] not in LEGACY:
        return False
    if f[0] in ("all", "any", "none"):
        return f[0] == "none" or any(is_legacy(x) for x in f[1:])
    if f[0] in ("has", "!has"):
        return f[0] == "!has" or f[1] in ("$type", "$id")
    if f[0] in ("in", "!in"):
        return f[0] == "!in" or (len(f) > 1 and isinstance(f[1], str) and (len(f) != 3 or not isinstance(f[2], list) or f[1].startswith("$")))
    return len(f) == 3 and isinstance(f[1], str) and not isinstance(f[2], list)


def legacy_filter(f: list, row: Row) -> Column:
    op, args = f[0], f[1:]
    if op in ("all", "any", "none"):
        out = F.lit(op == "all")
        for x in args:
            c = compile_filter(x, row)
            out = out & c if op == "all" else out | c
        return ~out if op == "none" else out
    compiler = Compiler(row)
    left = compiler(["geometry-type"]) if args[0] == "$type" else compiler(["id"]) if args[0] == "$id" else compiler(["get", args[0]])
    if op in ("has", "!has"):
        there = F.lit(True) if args[0] == "$type" else row.fid.isNotNull() if args[0] == "$id" else compiler(["has", args[0]]).bool
        return ~there if op == "!has" else there
    if op in ("in", "!in"):
        hit = F.lit(False)
        for v in args[1:]:
            hit = hit | equal(left, literal(v))
        return ~hit if op == "!in" else hit
    if op in ("==", "!="):
        same = equal(left, literal(str(args[1]) if args[0] == "$id" else args[1]))
        return ~same if op == "!=" else same
    return ordered(op, left, literal(args[1]))


def compile_filter(f: object, row: Row) -> Column:
    """True only where the filter's value is exactly true; never null. None passes everything."""
    if f is None:
        return F.lit(True)
    if is_legacy(f):
        return legacy_filter(f, row)
    return compile_expression(f, row).true()


def legacy_function(spec: dict) -> object:
    """An older {stops, base, property, type, default} function as an expression."""
    stops, kind = spec.get("stops", []), spec.get("type")
    x = ["get", spec["property"]] if "property" in spec else ["zoom"]
    smooth = all(isinstance(v, (int, float)) or (isinstance(v, str) and parse_color(v)) for _, v in stops)
    kind = kind or ("exponential" if smooth else "interval")
    if kind == "identity":
        return ["coalesce", x, spec.get("default")]
    if kind == "categorical":
        return ["match", x, *(y for s, v in stops for y in (s, v)), spec.get("default")]
    if kind == "interval":
        out = ["step", x, stops[0][1], *(y for s, v in stops[1:] for y in (s, v))]
    else:
        out = ["interpolate", ["exponential", spec.get("base", 1)], x, *(y for s, v in stops for y in (s, v))]
    return ["coalesce", out, spec["default"]] if "default" in spec else out


def fill_tokens(template: str) -> list:
    """A text with {name} tokens as an expression."""
    out, rest = ["concat"], template
    while "{" in rest and "}" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [before, ["coalesce", ["get", name], ""]]
    return [*out, rest]
