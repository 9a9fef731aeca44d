"""Line-protocol and JSON points as column expressions: rows either parse or carry an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

MAX_LINE_BYTES = 2048
#: Legal names: a fixed format.
_NAME = "^[A-Za-z0-9._/@-]*$"
_INTEGER = "^[+-]?[0-9]{1,19}$"


def words(line: Column) -> Column:
    """Words between single or repeated spaces."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def parse_long(text: Column) -> Column:
    """Null unless an optionally signed 64-bit integer."""
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def looks_like_integer(text: Column) -> Column:
    return ~text.rlike("[.eE]")


def is_list(text: Column) -> Column:
    return text.startswith("[") & text.endswith("]")


def list_items(text: Column) -> Column:
    """Texts of the items of `[a,b]`; an empty list has none, which is no value."""
    inner = text.substr(F.lit(2), F.length(text) - 2)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def float_text(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("float"))


def valid_name(text: Column) -> Column:
    return text.rlike(_NAME)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _point(line: Column, w: Column, shard_tags: tuple[str, ...]) -> Column:
    """A struct of a line's point and error, from the line and its words."""
    pairs = F.transform(F.slice(w, 5, F.greatest(F.size(w) - 4, F.lit(0))), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.when(t.contains("="), F.substring(t, F.instr(t, "=") + 1, F.length(t))).alias("value")))
    text = F.coalesce(F.get(w, F.lit(3)), F.lit(""))
    items = F.when(is_list(text), list_items(text))
    read = F.struct(line.alias("line"), w.alias("w"), parse_long(F.get(w, F.lit(2))).alias("ts"), text.alias("text"), items.alias("items"), F.forall(F.coalesce(items, F.array().cast("array<string>")), looks_like_integer).alias("whole"), pairs.alias("pairs"))
    return let(read, lambda r: let(_typed(r), lambda t: _judged(r, t, shard_tags)))


def _typed(r: Column) -> Column:
    listed, integer = r["items"].isNotNull(), looks_like_integer(r["text"])
    return F.struct(
        F.when(listed & r["whole"], "INT_LIST").when(listed, "FLOAT_LIST").when(integer, "INT").otherwise("FLOAT").alias("kind"),
        F.when(~listed & integer, parse_long(r["text"])).alias("int_value"),
        F.when(~listed & ~integer, float_text(r["text"])).alias("float_value"),
        F.when(listed & r["whole"], F.transform(r["items"], parse_long)).alias("int_list"),
        F.when(listed & ~r["whole"], F.transform(r["items"], float_text)).alias("float_list"),
        F.transform(r["pairs"], lambda p: p["key"]).alias("keys"),
        F.transform(r["pairs"], lambda p: p["value"]).alias("values"),
    )


def _judged(r: Column, t: Column, shard_tags: tuple[str, ...]) -> Column:
    w = r["w"]
    bad_item = F.when(r["items"].isNotNull(), F.exists(F.coalesce(t["int_list"].cast("array<double>"), t["float_list"].cast("array<double>")), lambda x: x.isNull()))
    error = (
        F.when(F.octet_length(r["line"]) > MAX_LINE_BYTES, "line too long")
        .when(F.coalesce(F.get(w, F.lit(0)), F.lit("")) != "put", "unknown command")
        .when(F.size(w) < 5, "not enough arguments")
        .when(r["ts"].isNull() | (r["ts"] <= 0), "invalid timestamp")
        .when(F.size(r["items"]) == 0, "empty values list")
        .when(F.exists(r["pairs"], lambda p: p["value"].isNull() | (p["value"] == "") | (p["key"] == "")), "invalid tag")
        .when(F.size(F.array_distinct(t["keys"])) < F.size(t["keys"]), "duplicate tag")
        .when(F.coalesce(bad_item, t["int_value"].isNull() & t["float_value"].isNull()), "invalid value")
        .when(r["ts"] >= 1 << 31, "timestamp out of range")
        .when(~valid_name(F.get(w, F.lit(1))) | F.exists(F.concat(t["keys"], t["values"]), lambda x: ~valid_name(x)), "illegal character")
        .when(F.coalesce(F.abs(t["float_value"]) == float("inf"), F.lit(False)), "value is not finite")
        .when(F.size(F.filter(t["keys"], lambda k: k.isin(*shard_tags))) != 1, "exactly one shard tag needed")
    )
    return let(error, lambda e: F.struct(
        F.get(w, F.lit(1)).alias("metric"), r["ts"].alias("ts"), *[t[c].alias(c) for c in ("kind", "int_value", "float_value", "int_list", "float_list")], e.alias("error"),
        F.when(e.isNull(), F.map_from_entries(F.filter(r["pairs"], lambda p: e.isNull()))).alias("tags"),
        F.when(e.isNull(), F.array_join(F.transform(F.array_sort(r["pairs"]), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")).alias("series_key"),
    ))


def parse_lines(lines: DataFrame, column: str = "line", shard_tags: tuple[str, ...] = model.SHARD_TAGS) -> DataFrame:
    """Adds metric, tags, series_key, ts, kind (INT, FLOAT, INT_LIST, FLOAT_LIST), int_value,
    float_value, int_list, float_list and error (null for valid points) to `put` lines.

    A carriage return at the end is cut. Values without '.', 'e' or 'E' are integers; a list is
    one of floats if any item is another. Valid times are positive and of 31 bits; names have
    legal characters only; exactly one tag is a shard tag; scalars are finite, list items needn't be.
    """
    line = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\\r$", "")
    point = let(line, lambda x: let(words(x), lambda w: _point(x, w, shard_tags)))
    fields = ("metric", "tags", "series_key", "ts", "kind", "int_value", "float_value", "int_list", "float_list", "error")
    return lines.withColumn("_point", point).select(*lines.columns, *[F.col(f"_point.{f}").alias(f) for f in fields])


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid points, quarantine with the reason in error)."""
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null")


def parse_json(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Points of JSON bodies {"host/metric": {"value": v, "timestamp": t, "type": "numeric"}}, a
    map or an array of maps: metric `l.<metric>`, tag host; the value's kind by its looks."""
    entry = "map<string,struct<value:string,timestamp:bigint,type:string>>"
    body = F.trim(F.col(column))
    maps = F.when(body.startswith("["), F.from_json(body, f"array<{entry}>")).otherwise(F.array(F.from_json(body, entry)))
    rows = bodies.withColumn("_m", F.explode(maps)).select("*", F.explode("_m").alias("_name", "_p")).drop("_m")
    text = F.col("_p.value")
    return rows.select(
        *[F.col(c) for c in bodies.columns],
        F.concat(F.lit("l."), F.expr("substr(_name, instr(_name, '/') + 1)")).alias("metric"),
        F.create_map(F.lit("host"), F.substring_index("_name", "/", 1)).alias("tags"),
        F.col("_p.timestamp").alias("ts"),
        F.when(looks_like_integer(text), "INT").otherwise("FLOAT").alias("kind"),
        F.when(looks_like_integer(text), parse_long(text)).alias("int_value"),
        F.when(~looks_like_integer(text), float_text(text)).alias("float_value"),
    )


def checked(points: DataFrame, shard_tags: tuple[str, ...] = model.SHARD_TAGS) -> DataFrame:
    """Adds series_key and error (null for valid points) to scalar points that are not lines, such as
    parse_json's: names, times, values and shard tags are held to the rules of lines."""
    names = F.concat(F.array("metric"), F.map_keys("tags"), F.map_values("tags"))
    error = (
        F.when(F.col("ts").isNull() | (F.col("ts") <= 0), "invalid timestamp")
        .when(F.coalesce(F.exists(names, lambda x: x.isNull() | (x == "")), F.lit(True)), "invalid tag")
        .when(F.col("int_value").isNull() & F.col("float_value").isNull(), "invalid value")
        .when(F.col("ts") >= 1 << 31, "timestamp out of range")
        .when(F.exists(names, lambda x: ~valid_name(x)), "illegal character")
        .when(F.coalesce(F.abs("float_value") == float("inf"), F.lit(False)), "value is not finite")
        .when(F.size(F.filter(F.map_keys("tags"), lambda k: k.isin(*shard_tags))) != 1, "exactly one shard tag needed")
    )
    return points.withColumns({"series_key": model.series_key(F.col("tags")), "error": error})


def to_lines(points: DataFrame) -> DataFrame:
    """Scalar points as `put` lines, which parse_lines reads back: what a queue or a file carries."""
    value = F.when(F.col("kind") == "INT", F.col("int_value").cast("string")).otherwise(F.col("float_value").cast("string"))
    return points.select("series_key", F.concat_ws(" ", F.lit("put"), "metric", F.col("ts").cast("string"), value, F.regexp_replace("series_key", ",", " ")).alias("line"))
