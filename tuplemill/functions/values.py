"""Tagged values: one Spark struct for mixed-type columns.

``tval`` has a type rank first and one payload per kind of type, so that
Spark's field-by-field struct comparison *is* the total order across types:
NULL lowest and equal to itself, every int below every double below every
string, and so on.  Everything is built from Column expressions.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes, which are also the sort rank between types.
NULL, RECORD, INT, DOUBLE, STR, XMLLITERAL, URI, BLOB, CHAR, FIXPOINT, DATE, TIME, ANONCONST, VAR = range(1, 15)
NAMES = ("null", "record", "int", "double", "string", "xmlliteral", "uri", "blob", "char", "fixpoint", "date", "time", "anonymous constant", "variable")

TVAL = "struct<t:tinyint,i:bigint,d:double,x:string,s:string,b:binary,r:bigint>"
_PAYLOADS = {"i": "bigint", "d": "double", "x": "string", "s": "string", "b": "binary", "r": "bigint"}
DAY_ONE = "0001-01-01"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def tval(rank: int, **payload) -> Column:
    """A value of one type; NULL where its payload is NULL."""
    fields = [F.lit(rank).cast("tinyint").alias("t")]
    fields += [(_col(payload[k]) if k in payload else F.lit(None)).cast(kind).alias(k) for k, kind in _PAYLOADS.items()]
    made = F.struct(*fields).cast(TVAL)
    main = _col(payload["s"] if "s" in payload else next(iter(payload.values()), None))
    return made if rank == NULL else F.when(main.isNull(), null_value()).otherwise(made)


def null_value() -> Column:
    fields = [F.lit(NULL).cast("tinyint").alias("t"), *[F.lit(None).cast(kind).alias(k) for k, kind in _PAYLOADS.items()]]
    return F.struct(*fields).cast(TVAL)


def record(rid) -> Column:
    return tval(RECORD, r=rid)


def integer(v) -> Column:
    return tval(INT, i=v)


def double(v) -> Column:
    return tval(DOUBLE, d=v)


def string(v) -> Column:
    """A string; a language tag belongs beside the value, as it doesn't count in comparisons."""
    return tval(STR, s=v)


def xmlliteral(v, xsdtype) -> Column:
    return tval(XMLLITERAL, s=v, x=xsdtype)


def uri(v, prefix=None) -> Column:
    """A URI; a missing prefix equals an empty one."""
    return tval(URI, s=v, x=F.coalesce(_col(prefix).cast("string"), F.lit("")))


def blob(v) -> Column:
    return tval(BLOB, b=v)


def char(v) -> Column:
    return tval(CHAR, s=F.substring(_col(v).cast("string"), 1, 1))


def fixpoint(v) -> Column:
    return tval(FIXPOINT, i=fixpoint_units(_col(v)))


def date(v) -> Column:
    """From a DATE column, or from a day number."""
    return tval(DATE, i=v)


def time(v) -> Column:
    """From hundredths of a second since midnight, up to 8,640,000."""
    return tval(TIME, i=v)


def anonconst(v) -> Column:
    return tval(ANONCONST, s=v)


def variable(n) -> Column:
    return tval(VAR, i=n)


@dataclass(frozen=True)
class Typed:
    """A Python value of a type that Python itself lacks: char, uri, xmlliteral, fixpoint, record, anonconst."""

    kind: str
    value: object
    extra: str | None = None

    def column(self) -> Column:
        makers = {"char": char, "uri": uri, "xmlliteral": xmlliteral, "fixpoint": fixpoint, "record": record, "anonconst": anonconst}
        if self.kind not in makers:
            raise TypeError(f"no type {self.kind!r}")
        if self.kind in ("uri", "xmlliteral"):
            return makers[self.kind](F.lit(self.value), F.lit(self.extra))
        return makers[self.kind](F.lit(self.value))


def of_python(value) -> Column:
    """The tagged value of a Python value: None, int, float, str, bytes, date, time or ``Typed``; there are no booleans."""
    if isinstance(value, Column):
        return value
    if isinstance(value, Typed):
        return value.column()
    if value is None:
        return null_value()
    if isinstance(value, bool):
        raise TypeError("there is no boolean type")
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return date(F.lit(value.toordinal()))
    if isinstance(value, datetime.time):
        return time(F.lit(((value.hour * 60 + value.minute) * 60 + value.second) * 100 + value.microsecond // 10_000))
    for kind, make in ((int, integer), (float, double), (str, string), (bytes, blob)):
        if isinstance(value, kind):
            return make(F.lit(value))
    raise TypeError(f"no tagged value for {type(value).__name__}")


# -- comparison and types


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the total order."""
    return F.when(a == b, 0).when(a < b, -1).otherwise(1)


def type_name(value: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), value["t"].cast("int"))


def compare_records(a: Column, b: Column) -> Column:
    """Records as arrays of tagged values: by length, then field by field."""
    return F.when(F.size(a) != F.size(b), F.when(F.size(a) < F.size(b), -1).otherwise(1)).when(a == b, 0).when(a < b, -1).otherwise(1)


# -- text to value

_DATE, _TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}:\d{2}:\d{2}(\.\d{1,2})?$"


def parse_date(text: Column, lenient: bool = False) -> Column:
    """The day number of YYYY-MM-DD, or -1.

    Strict unless ``lenient``: unpadded parts, trailing characters and days
    that a month lacks are then let through (the latter run into the next).
    """
    if not lenient:
        day = F.expr("null").cast("date")
        day = F.when(text.rlike(_DATE), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).otherwise(day)
        good = day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") == text)
        return F.when(good, day_number(day)).otherwise(F.lit(-1)).cast("int")
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+)-(\d{1,2})-(\d{1,2})", k).try_cast("int")
    y, m, d = part(1), part(2), part(3)
    return F.coalesce(F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31) & (y >= 1), day_number(F.make_date(y, m, F.lit(1))) + d - 1), F.lit(-1)).cast("int")


def parse_time(text: Column, lenient: bool = False) -> Column:
    """Hundredths of a second of HH:MM:SS or HH:MM:SS.cc, or -1."""
    shape = r"^(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,2}))?$" if not lenient else r"^\s*(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,2}))?"
    part = lambda k: F.regexp_extract(text, shape, k)
    h, m, s = (part(k).try_cast("int") for k in (1, 2, 3))
    cents = F.when(part(4) == "", 0).otherwise(F.rpad(part(4), 2, "0").try_cast("int"))
    limits = (h <= 24) & (m <= (60 if lenient else 59)) & (s <= (60 if lenient else 59)) & ((h < 24) | ((m == 0) & (s == 0) & (cents == 0)))
    return F.coalesce(F.when(text.rlike(shape) & limits, ((h * 60 + m) * 60 + s) * 100 + cents), F.lit(-1)).cast("int")


def infer(text: Column) -> Column:
    """The tagged value of a text: NULL, date, time, int, double or string.

    Only a text that begins with a digit, or a minus and a digit, can be a
    number; ints that don't fit 64 bits stay strings.
    """
    return (
        F.when(text.isNull() | (text == ""), null_value())
        .when(parse_date(text) >= 0, date(parse_date(text)))
        .when(parse_time(text) >= 0, time(parse_time(text)))
        .when(text.rlike(r"^-?\d+$") & text.try_cast("bigint").isNotNull(), integer(text.try_cast("bigint")))
        .when(text.rlike(r"^-?\d+\.\d*$"), double(text.try_cast("double")))
        .otherwise(string(text))
    )


# -- dates, times, fixpoints


def day_number(day: Column) -> Column:
    """0001-01-01 is day 1."""
    return F.datediff(day, F.to_date(F.lit(DAY_ONE))) + 1


def ymd_to_date(y: Column, m: Column, d: Column) -> Column:
    return F.when(m.between(1, 12) & d.between(1, 31) & y.between(1, 9999), day_number(F.make_date(y, m, F.lit(1))) + d - 1).otherwise(-1).cast("int")


def date_of(number: Column) -> Column:
    return F.date_add(F.to_date(F.lit(DAY_ONE)), (number - 1).cast("int"))


def date_to_ymd(number: Column) -> Column:
    day = date_of(number)
    return F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))


def hms_to_time(h: Column, m: Column, s: Column, cents: Column) -> Column:
    ok = h.between(0, 24) & m.between(0, 60) & s.between(0, 60) & cents.between(0, 99)
    return F.when(ok, ((h * 60 + m) * 60 + s) * 100 + cents).otherwise(-1).cast("int")


def time_to_hms(t: Column) -> Column:
    part = lambda size, n: (F.floor(t / size) % n).cast("int") if n else F.floor(t / size).cast("int")
    return F.struct(part(360_000, 0).alias("hour"), part(6000, 60).alias("minute"), part(100, 60).alias("second"), (t % 100).cast("int").alias("cents"))


def format_time(t: Column) -> Column:
    p = time_to_hms(t)
    return F.format_string("%02d:%02d:%02d.%02d", p["hour"], p["minute"], p["second"], p["cents"])


def format_datetime(day: Column, t: Column) -> Column:
    return F.concat(F.date_format(date_of(day), "yyyy-MM-dd"), F.lit("T"), format_time(t))


def current_date(utc: bool = True) -> Column:
    """Today's day number, in UTC or in the session's time zone."""
    now = F.current_timestamp()
    return day_number(F.to_date(F.to_utc_timestamp(now, F.current_timezone()) if utc else now))


def current_time(utc: bool = True) -> Column:
    """Hundredths of a second since midnight, in UTC or in the session's time zone."""
    now = F.current_timestamp()
    now = F.to_utc_timestamp(now, F.current_timezone()) if utc else now
    cents = F.floor(F.date_format(now, "SSSSSS").cast("int") / 10_000).cast("int")
    return hms_to_time(F.hour(now), F.minute(now), F.second(now), cents)


def fixpoint_units(v: Column) -> Column:
    """Ten-thousandths, rounded half away from zero; NULL beyond -800 to 800."""
    return F.when(v.between(-800, 800), F.round(v * 10_000).cast("bigint"))


def pretty_size(n: Column) -> Column:
    """Bytes, kB, MB or GB by thousands."""
    return F.when(n >= 10**9, F.format_string("%d GB", F.floor(n / 10**9))).when(n >= 10**6, F.format_string("%d MB", F.floor(n / 10**6))).when(n >= 1000, F.format_string("%d kB", F.floor(n / 1000))).otherwise(F.format_string("%d bytes", n))


# -- value to text


def print_value(v: Column) -> Column:
    """The text of a tagged value, as a dump shows it."""
    t, i, s, x = v["t"], v["i"], v["s"], v["x"]
    return (
        F.when(t == NULL, F.lit("NULL"))
        .when(t == RECORD, F.concat(F.lit("<rec "), v["r"].cast("string"), F.lit(">")))
        .when(t == INT, i.cast("string"))
        .when(t == DOUBLE, F.format_string("%.6f", v["d"]))
        .when(t == STR, F.concat(F.lit('"'), s, F.lit('"')))
        .when(t == XMLLITERAL, F.concat(F.lit("<xsdtype "), x, F.lit('>"'), s, F.lit('"')))
        .when(t == URI, F.when(x == "", s).otherwise(F.concat(x, F.lit(":"), s)))
        .when(t == BLOB, F.concat(F.lit("<blob "), F.octet_length(v["b"]).cast("string"), F.lit(">")))
        .when(t == CHAR, s)
        .when(t == FIXPOINT, F.format_string("%.6f", i / 10_000))
        .when(t == DATE, F.concat(F.lit("<raw date "), i.cast("string"), F.lit(">"), F.date_format(date_of(i), "yyyy-MM-dd")))
        .when(t == TIME, F.concat(F.lit("<raw time "), i.cast("string"), F.lit(">"), format_time(i)))
        .when(t == ANONCONST, F.concat(F.lit("!"), s))
        .when(t == VAR, F.concat(F.lit("?"), i.cast("string")))
    )


def print_record(fields: Column) -> Column:
    """``[f,f,...]`` of an array of tagged values."""
    return F.concat(F.lit("["), F.array_join(F.transform(fields, print_value), ","), F.lit("]"))


def csv_field(v: Column) -> Column:
    """The CSV text of a value: strings quoted, NULL empty."""
    quoted = lambda s: F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    t, i = v["t"], v["i"]
    return (
        F.when(t == NULL, F.lit(""))
        .when(t == RECORD, F.concat(F.lit('"<record offset '), v["r"].cast("string"), F.lit('>"')))
        .when(t == INT, i.cast("string"))
        .when(t == DOUBLE, F.format_string("%.6f", v["d"]))
        .when(t.isin(STR, XMLLITERAL, CHAR), quoted(v["s"]))
        .when(t == URI, quoted(F.concat(v["x"], v["s"])))
        .when(t == FIXPOINT, F.format_string("%.6f", i / 10_000))
        .when(t == DATE, F.date_format(date_of(i), "yyyy-MM-dd"))
        .when(t == TIME, format_time(i))
        .otherwise(F.lit('"<unsupported type>"'))
    )


def csv_line(fields: Column) -> Column:
    return F.array_join(F.transform(fields, csv_field), ",")


def escape_json(s: Column) -> Column:
    """A JSON string literal, quotes included."""
    text = F.to_json(F.struct(s.alias("v")))
    return text.substr(F.lit(6), F.length(text) - 6)


def url_decode(s: Column) -> Column:
    """%XX escapes only: a plus sign stays one."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def string_bytes(s: Column) -> Column:
    return F.octet_length(s)


def short_double(d: Column) -> Column:
    """A double with six significant digits and no trailing zeros, as ``%g`` of C prints it."""
    size = F.abs(d)
    power = F.when(size == 0, F.lit(0)).otherwise(F.regexp_extract(F.format_string("%.5e", d), r"e([+-]\d+)$", 1).cast("int"))
    fixed = F.lit(None).cast("string")
    for k in range(-4, 6):
        fixed = F.when(power == k, F.format_string(f"%.{5 - k}f", d)).otherwise(fixed)
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", d), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    return F.when((power < -4) | (power > 5), science).otherwise(trimmed)
