"""Binary tables of FITS files: headers, columns, and rows as Arrow arrays.

A file is a sequence of units of 2880-byte blocks. Each begins with a header of
80-character cards; a binary table's rows follow it, big-endian and all of one
length, and behind them a heap that arrays of varying length point into.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

BLOCK, CARD = 2880, 80
#: Largest stretch of a heap that is read at once; beyond it each array is read by itself.
HEAP = 64 << 20

# The format's element codes, as numpy and Spark have them.
NUMPY = {"L": "S1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "S1", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "P": ">i4", "Q": ">i8"}
COMPLEX = {"C": T.FloatType(), "M": T.DoubleType()}
SPARK = {"L": T.BooleanType(), "X": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "A": T.StringType(), "E": T.FloatType(), "D": T.DoubleType()} | {c: T.StructType([T.StructField("re", t), T.StructField("im", t)]) for c, t in COMPLEX.items()}
#: Signed integers stand for unsigned ones (and bytes for signed ones) if this is added to them.
SHIFTED = {"B": (-(1 << 7), T.ByteType()), "I": (1 << 15, T.IntegerType()), "J": (1 << 31, T.LongType()), "K": (1 << 63, T.DecimalType(20, 0))}


class FitsError(ValueError):
    """A file that isn't what the format asks for; the text names the file."""


def card_value(text: str) -> object:
    """The value of a card behind ``= ``: a string, a logical, a number, or None."""
    text = text.lstrip()
    if text.startswith("'"):
        whole = re.match(r"'((?:[^']|'')*)'", text)
        return whole[1].replace("''", "'").rstrip() if whole else text[1:].rstrip()
    word = text.split("/", 1)[0].strip()
    if word in ("T", "F"):
        return word == "T"
    for kind in (int, float):
        try:
            return kind(word.upper().replace("D", "E") if kind is float else word)
        except ValueError:
            continue
    return word or None


def read_header(file: BinaryIO) -> dict[str, object] | None:
    """The cards of the header at the file's place, first ones winning; None at the end of the file. Long strings go on in CONTINUE cards."""
    cards: dict[str, object] = {}
    last = None
    while True:
        block = file.read(BLOCK)
        if not block.strip(b" \0") and not cards:
            return None
        if len(block) < BLOCK:
            raise FitsError("a header ends early")
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("latin-1")
            name = card[:8].rstrip()
            if name == "END":
                return cards
            if card[8:10] == "= " and name:
                last = name if name not in cards else None
                cards.setdefault(name, card_value(card[10:]))
            elif name == "CONTINUE" and last and str(cards[last]).endswith("&"):
                cards[last] = str(cards[last])[:-1] + str(card_value(card[10:]) or "")


def data_bytes(header: dict[str, object]) -> int:
    """Bytes of the data behind a header, padding included."""
    axes = [int(header.get(f"NAXIS{i + 1}") or 0) for i in range(int(header.get("NAXIS") or 0))]
    size = abs(int(header.get("BITPIX") or 8)) // 8 * int(header.get("GCOUNT") or 1) * (int(header.get("PCOUNT") or 0) + math.prod(axes)) if axes else 0
    return -(-size // BLOCK) * BLOCK


@dataclass(frozen=True)
class Column:
    """A column of a binary table. ``heap``: the code of the elements that descriptors point to."""

    name: str
    code: str
    repeat: int
    offset: int
    heap: str = ""
    scale: float = 1
    zero: float = 0
    null: int | None = None

    @property
    def width(self) -> int:
        return -(-self.repeat // 8) if self.code == "X" else self.repeat * np.dtype(NUMPY[self.code]).itemsize * (2 if self.code in "PQ" else 1)

    def element(self) -> T.DataType:
        code = self.heap or self.code
        if self.scale == 1 and self.zero == 0 or code in "LXACM":
            return SPARK[code]
        return SHIFTED[code][1] if code in SHIFTED and self.scale == 1 and self.zero == SHIFTED[code][0] else T.DoubleType()

    def spark(self) -> T.DataType:
        one = self.element()
        if self.code == "A" or self.heap == "A":
            return T.StringType()
        return T.ArrayType(one) if self.heap or self.code == "X" or self.repeat > 1 else one


@dataclass(frozen=True)
class Table:
    """Where a binary table's rows and heap lie in its file, and its columns."""

    header: dict = field(hash=False)
    primary: dict = field(hash=False)
    start: int
    rows: int
    row_bytes: int
    heap_start: int
    columns: tuple[Column, ...]

    def column(self, name: str) -> Column | None:
        """By name; upper and lower case are the same where there is no exact match."""
        exact = [c for c in self.columns if c.name == name] or [c for c in self.columns if c.name.lower() == name.lower()]
        return exact[0] if exact else None

    def keyword(self, name: str) -> object:
        """A header's value: the table's, or else the file's."""
        name = name.upper()
        return self.header[name] if name in self.header else self.primary.get(name)


def columns_of(header: dict[str, object]) -> tuple[Column, ...]:
    out, offset = [], 0
    for i in range(1, int(header.get("TFIELDS") or 0) + 1):
        form = re.match(r"\s*(\d*)([LXBIJKAEDCMPQ])\s*([LXBIJKAEDCM]?)", str(header.get(f"TFORM{i}")))
        if not form:
            raise FitsError(f"no usable TFORM{i}")
        repeat, code = int(form[1] or 1), form[2]
        name = str(header.get(f"TTYPE{i}") or f"col{i}")
        null = header.get(f"TNULL{i}")
        scale, zero = header.get(f"TSCAL{i}"), header.get(f"TZERO{i}")
        own = Column(name, code, repeat, offset, form[3] if code in "PQ" else "", 1 if scale is None else scale, 0 if zero is None else zero, int(null) if null is not None else None)
        out.append(own)
        offset += own.width
    return tuple(out)


def tables(file: BinaryIO) -> Iterator[Table]:
    """The binary tables of a file, in order."""
    primary, at = None, 0
    while True:
        file.seek(at)
        if (header := read_header(file)) is None:
            return
        if primary is None:
            if "SIMPLE" not in header:
                raise FitsError("no SIMPLE card")
            primary = header
        start = file.tell()
        if header.get("XTENSION") == "BINTABLE":
            width, rows = int(header["NAXIS1"]), int(header["NAXIS2"])
            columns = columns_of(header)
            if sum(c.width for c in columns) != width:
                raise FitsError(f"rows of {width} bytes, but columns of {sum(c.width for c in columns)}")
            heap = header.get("THEAP")
            yield Table(header, primary, start, rows, width, start + (int(heap) if heap is not None else rows * width), columns)
        at = start + data_bytes(header)


def find_table(file: BinaryIO, wanted: str | None = None) -> Table:
    """The table of this EXTNAME or number (from 1, in order of the binary tables); without one, the first."""
    for nth, table in enumerate(tables(file), 1):
        if wanted is None or wanted == str(nth) or wanted.lower() == str(table.header.get("EXTNAME", "")).lower():
            return table
    raise FitsError(f"no binary table {wanted or ''}".rstrip())


def _numbers(values: np.ndarray, column: Column, zero_as_null: bool) -> pa.Array:
    """One element a place, nulls and scales applied."""
    code = column.heap or column.code
    if code == "L":
        return pa.array(values == b"T", mask=~np.isin(values, (b"T", b"F")))
    if code == "A":
        return pa.array([v.split(b"\0", 1)[0].decode("latin-1").rstrip() for v in values.tolist()], pa.string())
    if code in COMPLEX:
        native = values.astype(values.dtype.newbyteorder("="))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(native.real)), pa.array(np.ascontiguousarray(native.imag))], names=["re", "im"])
    native = values.astype(values.dtype.newbyteorder("="))
    mask = np.zeros(len(native), bool) if column.null is None or code in "ED" else native == column.null
    shown = column.element()
    if isinstance(shown, T.DecimalType):
        return pa.array([None if m else Decimal(int(v) + (1 << 63)) for v, m in zip(native.tolist(), mask, strict=True)], pa.decimal128(20, 0))
    if isinstance(shown, T.DoubleType) and code != "D" or column.scale != 1 or column.zero != 0:
        native = native.astype(np.int64) + int(column.zero) if code in SHIFTED and not isinstance(shown, T.DoubleType) else native * float(column.scale) + float(column.zero)
    if zero_as_null:
        mask = mask | (native == 0)
    return pa.array(native, mask=mask)


def _heap(file: BinaryIO, table: Table, column: Column, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The elements that descriptors point to, one array behind the other."""
    kind = np.dtype(NUMPY[column.heap])
    size = -(-count // 8) if column.heap == "X" else count * kind.itemsize
    held = np.flatnonzero(size)
    if not len(held):
        return np.zeros(0, kind)
    low, high = int(place[held].min()), int((place + size)[held].max())
    if high - low <= max(HEAP, 4 * int(size.sum())):
        file.seek(table.heap_start + low)
        whole = file.read(high - low)
        parts = [whole[p - low : p - low + n] for p, n in zip(place[held].tolist(), size[held].tolist(), strict=True)]
    else:
        parts = []
        for p, n in zip(place[held].tolist(), size[held].tolist(), strict=True):
            file.seek(table.heap_start + p)
            parts.append(file.read(n))
    if sum(map(len, parts)) != int(size.sum()):
        raise FitsError("the heap ends early")
    return np.frombuffer(b"".join(parts), kind)


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def decode(file: BinaryIO, table: Table, column: Column, raw: np.ndarray, zero_as_null: bool = False) -> pa.Array:
    """A column of the rows ``raw`` (rows, bytes)."""
    n, own = len(raw), np.ascontiguousarray(raw[:, column.offset : column.offset + column.width])
    if column.code in "PQ":
        if not column.repeat:
            return pa.nulls(n)
        pointers = own.view(NUMPY[column.code]).reshape(n, 2).astype(np.int64)
        values, count = _heap(file, table, column, pointers[:, 0], pointers[:, 1]), pointers[:, 0]
        if column.heap == "A":
            ends, blob = np.cumsum(count), values.tobytes()
            return pa.array([blob[e - c : e].split(b"\0", 1)[0].decode("latin-1").rstrip() for e, c in zip(ends.tolist(), count.tolist(), strict=True)], pa.string())
        if column.heap == "X":
            starts = np.concatenate([[0], np.cumsum(-(-count // 8))[:-1]]) * 8 if n else np.zeros(0, int)
            bits = np.unpackbits(values)
            return _lists(count, pa.array(np.concatenate([bits[s : s + c] for s, c in zip(starts, count, strict=True)] or [bits[:0]]).astype(bool)))
        return _lists(count, _numbers(values, column, zero_as_null))
    if not column.repeat:
        return pa.nulls(n)
    if column.code == "A":
        return _numbers(own.view(f"S{column.repeat}").ravel(), column, False)
    if column.code == "X":
        return _lists(np.full(n, column.repeat), pa.array(np.unpackbits(own, axis=1)[:, : column.repeat].astype(bool).ravel()))
    values = _numbers(own.view(NUMPY[column.code]).ravel(), column, zero_as_null)
    return values if column.repeat == 1 else _lists(np.full(n, column.repeat), values)


# --- writing ---------------------------------------------------------------

#: Element code, and for integers the value that stands for null.
WRITTEN = {T.BooleanType: ("L", None), T.ByteType: ("I", -(1 << 15)), T.ShortType: ("I", -(1 << 15)), T.IntegerType: ("J", -(1 << 31)), T.LongType: ("K", -(1 << 63)), T.FloatType: ("E", None), T.DoubleType: ("D", None), T.StringType: ("A", None)}


def card(name: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    else:
        text = f"{value:>20}"
    if len(text) > CARD - 10:
        raise FitsError(f"{name} is too long for a card")
    return f"{name:<8}= {text}".ljust(CARD).encode("latin-1")


def block(*cards: bytes) -> bytes:
    whole = b"".join([*cards, b"END".ljust(CARD)])
    return whole.ljust(-(-len(whole) // BLOCK) * BLOCK)


def encode(batch: pa.RecordBatch, schema: T.StructType) -> tuple[list[bytes], np.ndarray]:
    """(cards of the columns, rows (rows, bytes)) of a batch. Null numbers are NaN or the TNULL card's value, null booleans 0, null strings empty. Raises FitsError for other types and for the value that stands for null."""
    cards, parts = [], []
    for i, f in enumerate(schema, 1):
        if type(f.dataType) not in WRITTEN:
            raise FitsError(f"{f.name}: no column of type {f.dataType.simpleString()}")
        code, null = WRITTEN[type(f.dataType)]
        values, width = batch.column(i - 1), 1
        if code == "A":
            texts = [(v or "").encode("latin-1", "replace") for v in values.to_pylist()]
            width = max([1, *map(len, texts)])
            own = np.array(texts, f"S{width}")
        elif code == "L":
            own = np.array([b"\0" if v is None else b"T" if v else b"F" for v in values.to_pylist()], "S1")
        else:
            if null is not None and pa.compute.any(pa.compute.equal(values, null)).as_py():
                raise FitsError(f"{f.name} holds {null}, which stands for null")
            own = values.fill_null(math.nan if null is None else null).to_numpy(zero_copy_only=False).astype(NUMPY[code])
        cards += [card(f"TTYPE{i}", f.name), card(f"TFORM{i}", f"{width}{code}")] + ([card(f"TNULL{i}", null)] if null is not None else [])
        parts.append(own.reshape(len(own), 1).view(np.uint8).reshape(len(own), -1))
    return cards, np.concatenate(parts, axis=1) if parts else np.zeros((batch.num_rows, 0), np.uint8)


def file_bytes(batch: pa.RecordBatch, schema: T.StructType, name: str) -> bytes:
    """A file with an empty primary unit and one binary table."""
    import pyarrow.compute  # noqa: F401

    cards, rows = encode(batch, schema)
    head = block(card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True))
    sizes = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", rows.shape[1]), card("NAXIS2", rows.shape[0]), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(schema))]
    data = rows.tobytes()
    return head + block(*sizes, *cards, card("EXTNAME", name)) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def names_of(schema: T.StructType, columns: Sequence[str] | None) -> T.StructType:
    """The fields of these names, in their order; all without names."""
    return schema if not columns else T.StructType([next(f for f in schema if f.name.lower() == c.lower()) for c in columns])
