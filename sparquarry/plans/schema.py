"""Records, keys, field schemas and their persisted documents."""

from __future__ import annotations

import dataclasses
import json
import math
import struct
import uuid
from typing import Any

from ..functions.text import Analyzer
from ..functions.vectors import METRICS

MAX_DIM = 4096


class StoreError(ValueError):
    pass


class SchemaMismatch(StoreError):
    pass


class NotCalibrated(StoreError):
    pass


class Busy(StoreError):
    pass


def encode_key(key: str | int | bytes) -> bytes:
    """A tag byte and the payload, so keys of different kinds never collide."""
    if isinstance(key, bool):
        raise TypeError("a bool is no key")
    if isinstance(key, str):
        return b"\x01" + key.encode()
    if isinstance(key, int):
        if not 0 <= key < 2**64:
            raise TypeError("an integer key must be from 0 to 2**64 - 1")
        return b"\x02" + struct.pack("<Q", key)
    if isinstance(key, (bytes, bytearray)):
        return b"\x03" + bytes(key)
    raise TypeError(f"{type(key).__name__} is no key")


def decode_key(raw: bytes) -> str | int | bytes:
    body = bytes(raw[1:])
    return {1: lambda: body.decode(), 2: lambda: struct.unpack("<Q", body)[0], 3: lambda: body}[raw[0]]()


def auto_key() -> str:
    return str(uuid.uuid4())


@dataclasses.dataclass(frozen=True)
class TextField:
    name: str
    analyzer: Analyzer = dataclasses.field(default_factory=Analyzer.english)


@dataclasses.dataclass(frozen=True)
class VectorField:
    """codec: "qam", "upq" or None (vectors as they are).  space: shared by name, else the field's own."""

    name: str
    dim: int
    metric: str = "cosine"
    codec: str | None = "qam"
    amp_bits: int = 5
    phase_bits: int = 6
    space: str | None = None
    sample_target: int = 50_000

    def __post_init__(self):
        if self.dim <= 0 or self.dim % 64 or self.dim > MAX_DIM:
            raise StoreError(f"dim must be a positive multiple of 64 up to {MAX_DIM}")
        if self.metric not in METRICS or self.codec not in ("qam", "upq", None):
            raise StoreError("unknown metric or codec")


@dataclasses.dataclass(frozen=True)
class Schema:
    fields: tuple[TextField | VectorField, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise StoreError("field names must differ")
        if any(n.startswith("~") for n in names):
            raise StoreError("names that start with ~ are reserved")
        if sum(isinstance(f, TextField) for f in self.fields) > 1:
            raise StoreError("a collection has one text field at most")
        spaces = [f.space for f in self.fields if isinstance(f, VectorField) and f.space]
        if len(set(spaces)) < len(spaces):
            raise StoreError("vector fields must have spaces of their own")

    def text(self, name: str, analyzer: Analyzer | None = None) -> Schema:
        return Schema((*self.fields, TextField(name, analyzer or Analyzer.english())))

    def vector(self, name: str, dim: int, **options: Any) -> Schema:
        return Schema((*self.fields, VectorField(name, dim, **options)))

    @property
    def text_field(self) -> TextField | None:
        return next((f for f in self.fields if isinstance(f, TextField)), None)

    @property
    def vector_fields(self) -> list[VectorField]:
        return [f for f in self.fields if isinstance(f, VectorField)]

    def extend(self, new: Schema) -> Schema:
        """Fields may only be added at the end."""
        for old, f in zip(self.fields, new.fields):
            if old != f:
                raise SchemaMismatch(f"field {old.name!r} differs")
        if len(new.fields) < len(self.fields):
            raise SchemaMismatch(f"field {self.fields[len(new.fields)].name!r} is missing")
        return new

    def to_json(self) -> dict:
        out = []
        for f in self.fields:
            d = dataclasses.asdict(f)
            out.append(dict(sorted(d.items())) | {"kind": "text" if isinstance(f, TextField) else "vector"})
        return {"fields": out, "version": 1}

    @classmethod
    def from_json(cls, doc: dict) -> Schema | None:
        """None for versions this code doesn't know: a collection without a shape.  Unknown entries are ignored."""
        if doc.get("version") != 1:
            return None
        fields: list[TextField | VectorField] = []
        for d in doc["fields"]:
            kind = TextField if d.get("kind") == "text" else VectorField
            known = {f.name: d[f.name] for f in dataclasses.fields(kind) if f.name in d}
            if kind is TextField:
                a = known["analyzer"]
                known["analyzer"] = Analyzer(**(a | {"stopwords": tuple(a["stopwords"])}))
            fields.append(kind(**known))
        return cls(tuple(fields))


@dataclasses.dataclass
class Record:
    """fields: text and vectors by field name; created_at: unix seconds, or None for now; parent: a key of the same collection."""

    key: str | int | bytes
    fields: dict[str, Any] = dataclasses.field(default_factory=dict)
    created_at: int | None = None
    parent: str | int | bytes | None = None


def check_record(schema: Schema, record: Record) -> None:
    by_name = {f.name: f for f in schema.fields}
    for name, value in record.fields.items():
        f = by_name.get(name)
        if f is None:
            raise StoreError(f"unknown field {name!r}")
        if isinstance(f, TextField):
            if not isinstance(value, str):
                raise StoreError(f"field {name!r} takes text")
            continue
        if isinstance(value, str):
            raise StoreError(f"field {name!r} takes a vector")
        if len(value) != f.dim:
            raise StoreError(f"field {name!r} has {f.dim} components, not {len(value)}")
        if not all(math.isfinite(float(x)) for x in value):
            raise StoreError(f"field {name!r} holds a component that is not finite")


def dumps(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True)
