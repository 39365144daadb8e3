"""Rows in a database's bulk copy formats, text and binary, as columns.

The formats are public and fixed: a text line has a field for each column between tabs,
``\\N`` for NULL and backslash escapes; a binary copy has a signature, then for each row the
number of its fields and each field's length (-1: NULL) and bytes in network order.
"""

from __future__ import annotations

import datetime
import decimal
import json
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
#: Escapes of one letter.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescaped(field: Column) -> Column:
    r"""Backslash escapes undone: letters, octal and hex bytes, and any other character itself."""
    # A doubled backslash is set aside first, so that it starts no escape.
    out = F.replace(field, F.lit("\\\\"), F.lit("\x00"))
    for letter, c in ESCAPES.items():
        out = F.replace(out, F.lit(f"\\{letter}"), F.lit(c))
    parts = F.split(out, r"(?<=\\)(?=[0-7]{1,3}|x[0-9A-Fa-f]{1,2})")
    # After a piece that ends in a backslash the next begins with digits.
    head = F.element_at(parts, 1)

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(x[0-9A-Fa-f]{1,2}|[0-7]{1,3})", 1)
        value = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 2), 16, 10)).otherwise(F.conv(digits, 8, 10)).cast("int")
        return F.concat(F.char(value), p.substr(F.length(digits) + 1, F.length(p)))

    def step(all_: Column, p: Column) -> Column:
        return F.when(all_.endswith("\\"), F.concat(all_.substr(F.lit(1), F.length(all_) - 1), piece(p))).otherwise(F.concat(all_, p))

    joined = F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts)), head, step)).otherwise(out)
    plain = F.regexp_replace(joined, r"\\(.)", "$1")
    return F.replace(plain, F.lit("\x00"), F.lit("\\"))


def _typed(field: Column, kind: T.DataType) -> Column:
    """A field's text as its column's type; arrays are written in braces."""
    if isinstance(kind, T.BooleanType):
        return F.when(field.isin("t", "true"), True).when(field.isin("f", "false"), False)
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.substring(field, 3, 2_000_000_000))
    if isinstance(kind, T.ArrayType):
        inner = F.regexp_replace(field, r"^\{|\}$", "")
        # Commas outside of quotes part the elements.
        parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
        return F.transform(parts, lambda x: _typed(F.when(x == "NULL", F.lit(None)).otherwise(F.regexp_replace(F.regexp_replace(x, r'^"|"$', ""), r"\\(.)", "$1")), kind.elementType))
    return field.cast(kind)


def decode_text(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines of a text copy as typed columns.  The end mark ``\\.`` is no row.

    A line with another number of fields fails the query: rows are never guessed.
    """
    struct_ = lines.sparkSession.createDataFrame([], schema).schema
    fields = F.split(F.col(column), "\t", -1)
    whole = F.when(F.size(fields) == len(struct_.fields), fields).otherwise(F.raise_error(F.concat(F.lit(f"{len(struct_.fields)} fields expected: "), F.col(column))))
    rows = lines.where(F.col(column) != "\\.").select(F.explode(F.array(whole)).alias("__f"))
    out = []
    for i, f in enumerate(struct_.fields):
        raw = F.col("__f")[i]
        out.append(F.when(raw != "\\N", _typed(_unescaped(raw), f.dataType)).alias(f.name))
    return rows.select(*out)


_EPOCH = datetime.datetime(2000, 1, 1)


def _numeric(raw: bytes) -> decimal.Decimal | None:
    """Digits in base 10,000, from the weight of the first on."""
    count, weight, sign, scale = struct.unpack(">hhHh", raw[:8])
    if sign == 0xC000:
        return None  # not a number; decimals have none
    digits = struct.unpack(f">{count}h", raw[8 : 8 + 2 * count])
    value = sum((decimal.Decimal(d).scaleb(4 * (weight - i)) for i, d in enumerate(digits)), decimal.Decimal(0))
    return round(-value if sign else value, scale)


def _array(raw: bytes, element: Callable[[bytes], Any]) -> list:
    """One dimension; those with more come flattened."""
    dims, _, _ = struct.unpack(">iiI", raw[:12])
    if not dims:
        return []
    count, at, out = 1, 12, []
    for _ in range(dims):
        count *= struct.unpack(">i", raw[at : at + 4])[0]
        at += 8
    for _ in range(count):
        (size,) = struct.unpack(">i", raw[at : at + 4])
        at += 4
        out.append(None if size < 0 else element(raw[at : at + size]))
        at += max(size, 0)
    return out


#: How the bytes of a database type are read.
BINARY: dict[str, Callable[[bytes], Any]] = {
    "bool": lambda b: b != b"\0",
    "int2": lambda b: struct.unpack(">h", b)[0],
    "int4": lambda b: struct.unpack(">i", b)[0],
    "int8": lambda b: struct.unpack(">q", b)[0],
    "float4": lambda b: struct.unpack(">f", b)[0],
    "float8": lambda b: struct.unpack(">d", b)[0],
    "text": lambda b: b.decode(),
    "bytea": bytes,
    "json": lambda b: json.dumps(json.loads(b)),
    "jsonb": lambda b: json.dumps(json.loads(b[1:])),  # a version comes first
    "uuid": lambda b: str(uuid.UUID(bytes=b)),
    "date": lambda b: (_EPOCH + datetime.timedelta(days=struct.unpack(">i", b)[0])).date(),
    "timestamp": lambda b: _EPOCH + datetime.timedelta(microseconds=struct.unpack(">q", b)[0]),
    "numeric": _numeric,
}
BINARY |= {name: BINARY["text"] for name in ("varchar", "bpchar", "enum", "name")}


def reader(kind: str) -> Callable[[bytes], Any]:
    if kind.endswith("[]"):
        element = reader(kind[:-2])
        return lambda b: _array(b, element)
    if kind not in BINARY:
        raise ValueError(f"no reader of {kind!r}")
    return BINARY[kind]


def binary_rows(data: bytes, kinds: Sequence[str]) -> Iterator[list]:
    """The rows of one binary copy; a broken one is an error."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a binary copy")
    (extension,) = struct.unpack(">i", data[15:19])
    at, readers = 19 + extension, [reader(k) for k in kinds]
    while True:
        (count,) = struct.unpack(">h", data[at : at + 2])
        at += 2
        if count == -1:
            return
        if count != len(kinds):
            raise ValueError(f"{count} fields, not {len(kinds)}")
        row = []
        for read in readers:
            (size,) = struct.unpack(">i", data[at : at + 4])
            at += 4
            row.append(None if size < 0 else read(data[at : at + size]))
            at += max(size, 0)
        yield row


def decode_binary(copies: DataFrame, kinds: Sequence[str], schema: str, column: str = "content", rows_at_once: int = 10_000) -> DataFrame:
    """Binary copies, one a row (as Spark reads binary files), as typed columns."""
    target = copies.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for data in batch.column(0):
                held: list[list] = []
                for row in binary_rows(data.as_py(), kinds):
                    held.append(row)
                    if len(held) == rows_at_once:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return copies.select(column).mapInArrow(run, target)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
