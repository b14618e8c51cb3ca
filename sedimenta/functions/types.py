"""Mapping of catalogue type codes and foreign type names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dictionary type codes and the names they stand for.
PLAIN_CODES = {
    "I8": "BIGINT",
    "I4": "INTEGER",
    "I2": "SMALLINT",
    "I1": "BYTEINT",
    "I": "INTEGER",
    "F": "FLOAT",
    "DA": "DATE",
    "AT": "TIME",
    "AZ": "TIME WITH TIME ZONE",
    "TS": "TIMESTAMP(6)",
    "TZ": "TIME WITH TIME ZONE",
    "SZ": "TIMESTAMP WITH TIME ZONE",
    "PS": "PERIOD(DATE)",
    "PT": "PERIOD(TIME)",
    "PM": "PERIOD(TIMESTAMP)",
    "PZ": "PERIOD(TIMESTAMP)",
    "CO": "CLOB",
    "BO": "BLOB",
    "YR": "INTERVAL YEAR",
    "YM": "INTERVAL YEAR TO MONTH",
    "MO": "INTERVAL MONTH",
    "DY": "INTERVAL DAY",
    "DH": "INTERVAL DAY TO HOUR",
    "DM": "INTERVAL DAY TO MINUTE",
    "DS": "INTERVAL DAY TO SECOND",
    "HR": "INTERVAL HOUR",
    "HM": "INTERVAL HOUR TO MINUTE",
    "HS": "INTERVAL HOUR TO SECOND",
    "MI": "INTERVAL MINUTE",
    "MS": "INTERVAL MINUTE TO SECOND",
    "SC": "INTERVAL SECOND",
    "JN": "JSON",
    "XM": "XML",
}
# Codes whose name carries a length, with the length used when none is stored.
SIZED_CODES = {"CV": ("VARCHAR", 255), "CF": ("CHAR", 1), "BV": ("VARBYTE", 64000), "BF": ("BYTE", 64000)}
DECIMAL_CODES = ["D", "N"]
# Type names that are accepted as they are, and beginnings of such names.
READY_NAMES = [
    "BIGINT", "INTEGER", "INT", "SMALLINT", "BYTEINT", "FLOAT", "REAL",
    "DOUBLE PRECISION", "DATE", "CLOB", "BLOB",
]
READY_PREFIX = (
    r"^(VARCHAR\(|CHAR\(|NVARCHAR\(|VARBYTE\(|BYTE\(|DECIMAL\(|NUMERIC\(|NUMBER\(|FLOAT\("
    r"|TIMESTAMP\(|TIME\(|PERIOD\(|INTERVAL )"
)
UNICODE = " CHARACTER SET UNICODE"
DEFAULT_TYPE = "VARCHAR(255)"
MAX_LENGTH = 64000


def _pick(code: Column, names: dict[str, str]) -> Column:
    """CASE over a fixed table of names."""
    picked = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in names.items():
        picked = picked.when(code == key, F.lit(name))
    return picked


def type_name(code: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Full type name of a dictionary type code.

    Ready-made type names pass through, a timestamp precision above 6 (a byte length in
    disguise) is replaced by the stored scale, and anything unknown becomes a default
    text type. A decimal scale of 0 stays 0.
    """
    given = F.trim(F.coalesce(code, F.lit("")))
    upper = F.upper(given)

    sized = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, (name, default) in SIZED_CODES.items():
        size = F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(default)).otherwise(length).cast("int")
        suffix = F.lit(UNICODE if key in ("CV", "CF") else "")
        sized = sized.when(upper == key, F.concat(F.lit(f"{name}("), size.cast("string"), F.lit(")"), suffix))
    decimal = F.when(
        upper.isin(DECIMAL_CODES),
        F.concat(
            F.lit("DECIMAL("),
            F.coalesce(precision.cast("int"), F.lit(18)).cast("string"),
            F.lit(","),
            F.coalesce(scale.cast("int"), F.lit(2)).cast("string"),
            F.lit(")"),
        ),
    )

    stored = F.regexp_extract(upper, r"^TIME(?:STAMP)?\(\s*(\d+)\s*\)", 1).try_cast("int")
    repaired = F.when(
        stored > 6,
        F.concat(
            F.regexp_extract(upper, r"^(TIME(?:STAMP)?)\(", 1),
            F.lit("("),
            F.least(F.coalesce(scale.cast("int"), F.lit(6)), F.lit(6)).cast("string"),
            F.lit(")"),
        ),
    )
    text_type = upper.rlike(r"^N?(VAR)?CHAR\(") & ~F.contains(upper, F.lit("CHARACTER SET"))
    passed = F.when(upper.isin(READY_NAMES), upper).when(
        upper.rlike(READY_PREFIX), F.concat(given, F.when(text_type, F.lit(UNICODE)).otherwise(F.lit("")))
    )
    return F.coalesce(_pick(upper, PLAIN_CODES), sized, decimal, repaired, passed, F.lit(DEFAULT_TYPE + UNICODE))


# Type names of the short display form.
SHORT_NAMES = {
    "I": "INTEGER", "I1": "BYTEINT", "I2": "SMALLINT", "I8": "BIGINT", "F": "FLOAT",
    "D": "DECIMAL", "N": "NUMBER", "CV": "VARCHAR", "CF": "CHAR", "CO": "CLOB", "BO": "BLOB",
    "BF": "BYTE", "BV": "VARBYTE", "DA": "DATE", "TS": "TIMESTAMP", "AT": "TIME",
    "TZ": "TIME WITH TIME ZONE", "SZ": "TIMESTAMP WITH TIME ZONE", "UT": "UDT",
}


def dictionary_type(code: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Short display form of a dictionary type code, the second of the two forms in use.

    Unknown codes show themselves; sizes appear only where they are stored.
    """
    key = F.trim(F.coalesce(code, F.lit("")))
    intervals = {k: v for k, v in PLAIN_CODES.items() if v.startswith("INTERVAL")}
    name = F.coalesce(_pick(key, SHORT_NAMES | intervals), key)

    def sized(*numbers: Column) -> Column:
        inner = F.concat_ws(",", *[n.cast("int").cast("string") for n in numbers])
        return F.concat(name, F.lit("("), inner, F.lit(")"))

    is_text = name.isin("VARCHAR", "CHAR", "BYTE", "VARBYTE")
    is_number = name.isin("DECIMAL", "NUMBER")
    is_time = name.isin("TIME", "TIME WITH TIME ZONE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE")
    return (
        F.when(is_text & (F.coalesce(length, F.lit(0)) != 0), sized(length))
        .when(is_number & precision.isNotNull() & (F.coalesce(scale, F.lit(0)) > 0), sized(precision, scale))
        .when(is_number & precision.isNotNull(), sized(precision))
        .when(is_time & scale.isNotNull(), sized(scale))
        .otherwise(name)
    )


_SPARK_TYPES = {
    "BIGINT": T.LongType(),
    "INTEGER": T.IntegerType(),
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "BYTEINT": T.ByteType(),
    "FLOAT": T.DoubleType(),
    "REAL": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "DATE": T.DateType(),
    "BLOB": T.BinaryType(),
    "BYTE": T.BinaryType(),
    "VARBYTE": T.BinaryType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
    "INTERVAL YEAR": T.YearMonthIntervalType(0, 0),
    "INTERVAL YEAR TO MONTH": T.YearMonthIntervalType(0, 1),
    "INTERVAL MONTH": T.YearMonthIntervalType(1, 1),
}
_DAY_UNITS = ["DAY", "HOUR", "MINUTE", "SECOND"]


def spark_type(name: str) -> T.DataType:
    """Spark type for a type name as built by :func:`type_name`; text for anything else."""
    plain = re.sub(r"\s+CHARACTER SET \w+$", "", name.strip().upper())
    numbers = [int(n) for n in re.findall(r"\d+", plain)]
    base = re.sub(r"\s+", " ", re.sub(r"\([\d\s,]*\)", "", plain)).strip()
    if base in ("DECIMAL", "NUMERIC", "NUMBER"):
        precision = numbers[0] if numbers else 18
        scale = numbers[1] if len(numbers) > 1 else (0 if numbers else 2)
        return T.DecimalType(precision, scale)
    period = re.fullmatch(r"PERIOD\((DATE|TIME|TIMESTAMP)\)", base)
    if period:
        inner = {"DATE": T.DateType(), "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType()}[period[1]]
        return T.StructType([T.StructField("begin", inner), T.StructField("end", inner)])
    interval = re.fullmatch(r"INTERVAL (DAY|HOUR|MINUTE|SECOND)(?: TO (HOUR|MINUTE|SECOND))?", base)
    if interval:
        first = _DAY_UNITS.index(interval[1])
        return T.DayTimeIntervalType(first, _DAY_UNITS.index(interval[2]) if interval[2] else first)
    return _SPARK_TYPES.get(base, T.StringType())
