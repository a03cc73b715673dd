"""Object ids and typed attribute values.

A value lives in the column of its type; ``v_type`` names it and ``v_ctx`` is the context of a scoped value, else null.
Values of different types never compare: 2024 is not 2024.0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_BITS = 48
TYPES = {"text": "v_text", "int": "v_int", "float": "v_float", "timestamp": "v_ts", "blob": "v_blob"}
VALUE_SCHEMA = T.StructType(
    [
        T.StructField("v_type", T.StringType()),
        T.StructField("v_text", T.StringType()),
        T.StructField("v_int", T.LongType()),
        T.StructField("v_float", T.DoubleType()),
        T.StructField("v_ts", T.LongType()),
        T.StructField("v_blob", T.BinaryType()),
        T.StructField("v_ctx", T.StringType()),
    ]
)
VALUE_COLUMNS = VALUE_SCHEMA.fieldNames()


class ValueError_(ValueError):
    """A value that has no place in the model."""


@dataclass(frozen=True)
class Value:
    """type: text, int, float, timestamp (nanoseconds) or blob."""

    type: str
    raw: str | int | float | bytes
    context: str | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError_(f"no such type of value: {self.type}")

    def scoped(self, context: str) -> Value:
        if self.context is not None:
            raise ValueError_("a scoped value can't be scoped again")
        return Value(self.type, self.raw, context)

    def __str__(self) -> str:
        plain = {
            "text": lambda: f'"{self.raw}"',
            "int": lambda: str(self.raw),
            "float": lambda: repr(float(self.raw)),
            "timestamp": lambda: f"ts:{self.raw}",
            "blob": lambda: f"blob[{len(self.raw)}]",
        }[self.type]()
        return plain if self.context is None else f"scoped({self.context},{plain})"

    def row(self) -> dict:
        return {c: None for c in VALUE_COLUMNS} | {"v_type": self.type, TYPES[self.type]: self.raw, "v_ctx": self.context}


_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)", re.IGNORECASE)


def bare(word: str, times: bool = False) -> Value:
    """A word without quotes: a 64-bit integer, else a float, else (where times are allowed) ns:<n> or s:<n>, else text."""
    if _INT.fullmatch(word) and -(2**63) <= int(word) < 2**63:
        return Value("int", int(word))
    if _FLOAT.fullmatch(word):
        return Value("float", float(word))
    if times and (m := re.fullmatch(r"(ns|s):([+-]?[0-9]+)", word)):
        return Value("timestamp", int(m[2]) * (1 if m[1] == "ns" else 10**9))
    return Value("text", word)


def from_python(x: object) -> Value:
    """A value of a TOML file: booleans are integers, whatever isn't a number or a string is its text."""
    if isinstance(x, bool):
        return Value("int", int(x))
    if isinstance(x, int):
        return Value("int", x)
    if isinstance(x, float):
        return Value("float", x)
    return Value("text", x if isinstance(x, str) else str(x))


def compare(a: Value, b: Value) -> int | None:
    """-1, 0 or 1; None for different types or scoped values. NaN equals itself and is the largest."""
    if a.type != b.type or a.context is not None or b.context is not None:
        return None
    if a.type == "float":
        ka, kb = (math.isnan(a.raw), 0 if math.isnan(a.raw) else a.raw), (math.isnan(b.raw), 0 if math.isnan(b.raw) else b.raw)
    elif a.type == "text":
        ka, kb = a.raw.encode(), b.raw.encode()
    else:
        ka, kb = a.raw, b.raw
    return (ka > kb) - (ka < kb)


def oid(node: int, local: int) -> int:
    value = (node & 0xFFFF) << NODE_BITS | (local & ((1 << NODE_BITS) - 1))
    return value - (1 << 64) if value >= 1 << 63 else value


def oid_column(node: int, local: Column) -> Column:
    return F.lit(oid(node, 0)).bitwiseOR(local.cast("long"))


def node_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, NODE_BITS)


def local_of(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << NODE_BITS) - 1))


def parse_oid(text: str) -> int:
    """obj:42, obj:0x2a or obj:<node in hex>:<local>."""
    if m := re.fullmatch(r"obj:([0-9a-fA-F]+):([0-9]+)", text):
        return oid(int(m[1], 16), int(m[2]))
    if m := re.fullmatch(r"obj:(?:0[xX]([0-9a-fA-F]+)|([0-9]+))", text):
        return oid(0, int(m[1], 16) if m[1] else int(m[2]))
    raise ValueError_(f"not an object id: {text}")


def format_oid(value: int) -> str:
    value &= (1 << 64) - 1
    return f"obj:{value >> NODE_BITS:x}:{value & ((1 << NODE_BITS) - 1)}"


def typed(kind: str, column: Column, context: Column | None = None) -> list[Column]:
    """The value columns for one attribute of that type."""
    cast = {"text": "string", "int": "long", "float": "double", "timestamp": "long", "blob": "binary"}
    out = []
    for f in VALUE_SCHEMA:
        if f.name == "v_type":
            out.append(F.lit(kind).alias("v_type"))
        elif f.name == "v_ctx":
            out.append((F.lit(None).cast("string") if context is None else context).alias("v_ctx"))
        elif f.name == TYPES[kind]:
            out.append(column.cast(cast[kind]).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return out
