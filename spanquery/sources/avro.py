"""Avro records without the Avro package: a schema's records as JSON, decoded on Arrow batches."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class _Bytes:
    """A cursor over one record."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the record ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        """A zig-zag number of seven bits a byte."""
        out = shift = 0
        while True:
            byte = self.take(1)[0]
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def text(self) -> str:
        return self.take(self.long()).decode("utf-8")


Read = Callable[[_Bytes], Any]


def _blocks(b: _Bytes, item: Callable[[], None]) -> None:
    """The items of an array or a map, which come in counted blocks."""
    while n := b.long():
        if n < 0:
            n = -n
            b.long()
        for _ in range(n):
            item()


def reader(schema: Any, named: dict[str, Read] | None = None) -> Read:
    """A function that reads one value of a schema; names that were defined before may be referred to."""
    named = {} if named is None else named
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict):
        return reader(kind, named)
    if isinstance(kind, list):
        options = [reader(s, named) for s in kind]
        return lambda b: options[b.long()](b)
    plain: dict[str, Read] = {
        "null": lambda b: None, "boolean": lambda b: b.take(1) != b"\0", "int": _Bytes.long, "long": _Bytes.long, "string": _Bytes.text, "bytes": lambda b: b.take(b.long()).hex(),
        "float": lambda b: struct.unpack("<f", b.take(4))[0], "double": lambda b: struct.unpack("<d", b.take(8))[0],
    }
    if kind in plain:
        return plain[kind]
    if kind == "enum":
        symbols = schema["symbols"]
        read: Read = lambda b: symbols[b.long()]
    elif kind == "fixed":
        size = schema["size"]
        read = lambda b: b.take(size).hex()
    elif kind == "array":
        item = reader(schema["items"], named)

        def read(b: _Bytes) -> list:
            out: list = []
            _blocks(b, lambda: out.append(item(b)))
            return out

    elif kind == "map":
        value = reader(schema["values"], named)

        def read(b: _Bytes) -> dict:
            out: dict = {}

            def one() -> None:
                key = b.text()
                out[key] = value(b)

            _blocks(b, one)
            return out

    elif kind == "record":
        fields: list[tuple[str, Read]] = []
        read = lambda b: {name: of(b) for name, of in fields}
        named[schema["name"]] = read
        fields += [(f["name"], reader(f["type"], named)) for f in schema["fields"]]
    elif kind in named:
        return named[kind]
    else:
        raise ValueError(f"unknown Avro type {kind!r}")
    if isinstance(schema, dict) and "name" in schema:
        named[schema["name"]] = read
    return read


def to_json(messages: DataFrame, schema: dict, body: str = "body", out: str = "json") -> DataFrame:
    """Append the JSON of the record in ``body``; NULL where it does not fit the schema, or is not wholly used."""
    kept = [f for f in messages.schema.fields if f.name != out]
    place = [f.name for f in kept].index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(schema)

        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            try:
                b = _Bytes(raw)
                value = read(b)
                return json.dumps(value) if b.at == len(raw) else None
            except (ValueError, IndexError, RecursionError):
                return None

        for batch in batches:
            texts = pa.array([one(raw) for raw in batch.column(place).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), texts], names=[*[f.name for f in kept], out])

    return messages.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
