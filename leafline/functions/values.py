"""Dynamic values: one struct type for whatever a record's metadata holds, and the text form that comparisons use."""

from __future__ import annotations

import datetime as dt
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField("repr", T.StringType()), T.StructField("text", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("bool", T.BooleanType())])
VALUE = T.StructType([*ITEM.fields, T.StructField("items", T.ArrayType(ITEM)), T.StructField("json", T.StringType())])
VALUES = T.MapType(T.StringType(), VALUE)
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def float_text(x: float) -> str:
    """Shortest digits; exponents from 21 on and below -4, with two digits at least."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, _, exponent = f"{x!r}".partition("e")
    digits = repr(x)
    power = math.floor(math.log10(abs(x)))
    power = int(f"{x:e}".split("e")[1]) if not exponent else int(exponent)
    if power < -4 or power >= 21:
        m = re.sub(r"\.?0+$", "", f"{x:.17e}".split("e")[0])
        for n in range(17):
            if float(f"{x:.{n}e}") == x:
                m = f"{x:.{n}e}".split("e")[0]
                break
        return f"{m}e{'+' if power >= 0 else '-'}{abs(power):02d}"
    if "e" in digits:
        digits = f"{x:.0f}" if power > 0 else f"{x:.20f}".rstrip("0")
    return digits[:-2] if digits.endswith(".0") else digits


def text_of(v) -> str:
    """The text form of a decoded value."""
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return float_text(v)
    if isinstance(v, dt.datetime):
        v = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        frac = f".{v.microsecond:06d}".rstrip("0") if v.microsecond else ""
        zone = "UTC" if not v.utcoffset() else v.strftime("%z")
        return v.strftime("%Y-%m-%d %H:%M:%S") + frac + f" {v.strftime('%z')} {zone}"
    if isinstance(v, dt.date):
        return f"{v:%Y-%m-%d} 00:00:00 +0000 UTC"
    if isinstance(v, (list, tuple)):
        return "[" + " ".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{text_of(k)}:{text_of(v[k])}" for k in sorted(v, key=str)) + "]"
    return str(v)


def repr_of(v) -> str:
    """Name of a value's representation."""
    for kind, name in ((type(None), "null"), (bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), ((dt.datetime, dt.date), "timestamp"), ((list, tuple), "sequence"), (dict, "mapping")):
        if isinstance(v, kind):
            return name
    return "string"


def number_of(v) -> float | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    return float(v) if isinstance(v, str) and re.match(NUMBER, v) else None


def item_of(v) -> dict:
    return {"repr": repr_of(v), "text": text_of(v), "num": number_of(v), "bool": v if isinstance(v, bool) else None}


def value_of(v) -> dict:
    """A decoded Python value as a VALUE row."""
    return item_of(v) | {"items": [item_of(x) for x in v] if isinstance(v, (list, tuple)) else None, "json": json.dumps(v, default=text_of, ensure_ascii=False, sort_keys=True)}


# ---- the same for columns


def number_in(text: Column) -> Column:
    """The number that a text is, by a stricter syntax than a cast's."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def item(kind: str, c: Column) -> Column:
    """An ITEM of a typed column."""
    none = F.lit(None)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        parts = ("integer", c.cast("string"), c.cast("double"), none)
    elif kind in ("float", "double") or kind.startswith("decimal"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        parts = ("number", F.when(whole, F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string")), d, none)
    elif kind == "boolean":
        parts = ("boolean", c.cast("string"), none, c)
    elif kind in ("timestamp", "date", "timestamp_ntz"):
        parts = ("timestamp", F.concat(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC")), none, none)
    else:
        s = c.cast("string")
        parts = ("string", s, number_in(s), none)
    text = F.coalesce(parts[1], F.lit("<nil>"))
    return F.struct(
        F.when(c.isNull(), F.lit("null")).otherwise(F.lit(parts[0])).alias("repr"), text.alias("text"), parts[2].cast("double").alias("num"), parts[3].cast("boolean").alias("bool"),
    )


def value(kind: str, c: Column) -> Column:
    """A VALUE of a typed column; arrays of scalars become sequences."""
    if kind.startswith("array<"):
        items = F.transform(c, lambda x: item(kind[6:-1], x))
        text = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["text"]), " "), F.lit("]"))
        head = F.struct(F.when(c.isNull(), F.lit("null")).otherwise(F.lit("sequence")).alias("repr"), F.coalesce(text, F.lit("<nil>")).alias("text"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"))
        return F.struct(head["repr"].alias("repr"), head["text"].alias("text"), head["num"].alias("num"), head["bool"].alias("bool"), items.alias("items"), F.to_json(c).alias("json"))
    one = item(kind, c)
    js = F.when(one["repr"].isin("integer", "number", "boolean"), one["text"]).when(one["repr"] == "null", F.lit("null")).otherwise(F.to_json(F.array(one["text"])).substr(2, 1 << 30))
    js = F.when(one["repr"].isin("string", "timestamp"), F.rtrim(F.regexp_replace(js, r"\]$", ""))).otherwise(js)
    return F.struct(one["repr"].alias("repr"), one["text"].alias("text"), one["num"].alias("num"), one["bool"].alias("bool"), F.lit(None).cast(T.ArrayType(ITEM)).alias("items"), js.alias("json"))
