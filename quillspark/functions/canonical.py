"""JSON with one form for each value: keys sorted at every depth, numbers and strings as Python's json writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(c: Column, kind: T.DataType, *, indent: int | None = None) -> Column:
    """The JSON text of a column of the given type, null as ``null``. With an indent, a line a member; else without white space."""
    return F.coalesce(_value(c, kind, indent, 0), F.lit("null"))


def canonical_row(df: DataFrame, *, indent: int | None = None) -> Column:
    """A whole row as one object."""
    return canonical_json(F.struct(*[F.col(f"`{n}`") for n in df.columns]), df.schema, indent=indent)


def write_canonical(df: DataFrame, path: str, by: list[str]) -> None:
    """A line a row, in the order of ``by`` over all files; an existing folder is an error. Equal tables give equal lines, however their rows are dealt."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).select(canonical_row(df).alias("value")).write.mode("errorifexists").text(path)


def _value(c: Column, kind: T.DataType, indent: int | None, depth: int) -> Column:
    """The text of a value; null for a null."""
    member = lambda x, k: F.coalesce(_value(x, k, indent, depth + 1), F.lit("null"))
    if isinstance(kind, T.StructType):
        # the names are known, so their order is decided here
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(": " if indent else ":"), member(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), _wrapped(F.array(*fields) if fields else F.array().cast("array<string>"), "{}", indent, depth))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of JSON objects are strings")
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.alias("k"))))
        values = F.transform(entries, lambda e: F.concat(_quoted(e["k"]), F.lit(": " if indent else ":"), member(F.element_at(c, e["k"]), kind.valueType)))
        return _wrapped(values, "{}", indent, depth)
    if isinstance(kind, T.ArrayType):
        return _wrapped(F.transform(c, lambda x: member(x, kind.elementType)), "[]", indent, depth)
    if isinstance(kind, T.BooleanType | T.IntegralType):
        return c.cast("string")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return _number(c.cast("double"))
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(c.cast("string"), r"(?<=\.[0-9]{0,38})0+$|\.0*$", "") if kind.scale else c.cast("string")
    return _quoted(c.cast("string"))


def _wrapped(members: Column, ends: str, indent: int | None, depth: int) -> Column:
    if indent is None:
        return F.concat(F.lit(ends[0]), F.array_join(members, ","), F.lit(ends[1]))
    line = "\n" + " " * indent * (depth + 1)
    full = F.concat(F.lit(ends[0] + line), F.array_join(members, "," + line), F.lit("\n" + " " * indent * depth + ends[1]))
    return F.when(F.size(members) == 0, F.lit(ends)).when(members.isNotNull(), full)


def _quoted(c: Column) -> Column:
    """A JSON string; characters beyond ASCII stay."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    rare = out
    for i in set(range(32)) - {8, 9, 10, 12, 13}:
        rare = F.replace(rare, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def _number(c: Column) -> Column:
    """A double as text: plain from 0.0001 up to 1e16, with an exponent of two digits or more beyond. The digits are those of Java's own text, the shortest but for a few numbers before Java 19."""
    text = F.abs(c).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.when(text.contains("E"), F.substring_index(text, "E", -1)).otherwise("0").cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    digits = F.regexp_replace(F.concat(whole, part), r"0+$", "")
    point = F.length(whole) + power  # digits before the point
    shown = F.rpad(digits, F.greatest(F.length(digits), point), F.lit("0"))
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).otherwise(
        F.concat(F.substr(shown, F.lit(1), point), F.lit("."), F.when(F.length(shown) > point, F.substr(shown, point + 1)).otherwise("0"))
    )
    known = F.regexp_replace(digits, "^0+", "")
    lead, rest = F.substring(known, 1, 1), F.substr(known, F.lit(2))
    short = F.concat(lead, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    sign = F.when((c < 0) | c.cast("string").startswith("-"), "-").otherwise("")
    away = (F.abs(c) >= 1e16) | ((F.abs(c) < 1e-4) & (c != 0))
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(c == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, F.when(away, short).otherwise(_plain_from(plain, text))))


def _plain_from(plain: Column, text: Column) -> Column:
    """Texts without an exponent are plain already."""
    return F.when(text.contains("E"), plain).otherwise(text)
