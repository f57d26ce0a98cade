"""MAT-file version 5 elements: numbers, texts, structures and cells, as far as recordings' headers need them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The format's numeric storage types and its array classes.
STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE = 1, 2, 3, 4, 5


class Stored:
    """A numeric array: its shape, and where its values lie, so that they need not be read."""

    def __init__(self, raw: bytes | memoryview, at: int, size: int, kind: str, shape: tuple[int, ...]):
        self.raw, self.at, self.size, self.kind, self.shape = raw, at, size, kind, shape

    def array(self) -> np.ndarray:
        return np.frombuffer(self.raw, self.kind, self.size // np.dtype(self.kind).itemsize, self.at).reshape(self.shape, order="F")

    def number(self) -> float:
        flat = self.array().ravel()
        return float(flat[0]) if len(flat) else float("nan")


def tag(raw: bytes | memoryview, at: int, end: str) -> tuple[int, int, int, int]:
    """Type, size, where the data begin, and where the next element does."""
    kind, size = struct.unpack_from(end + "II", raw, at)
    if kind >> 16:  # up to four bytes lie in the tag itself
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def matrix(raw: bytes | memoryview, at: int, end: str) -> tuple[str, object]:
    """Name and value of the array element whose data begin here."""
    _, _, data, at = tag(raw, at, end)
    kind = struct.unpack_from(end + "I", raw, data)[0] & 0xFF
    _, size, data, at = tag(raw, at, end)
    shape = struct.unpack_from(end + f"{size // 4}i", raw, data)
    _, size, data, at = tag(raw, at, end)
    name = bytes(raw[data : data + size]).decode("latin1")
    count = int(np.prod(shape))
    if kind in (CELL, STRUCT, OBJECT):
        fields = [""]
        if kind == OBJECT:
            _, _, _, at = tag(raw, at, end)
        if kind != CELL:
            _, _, data, at = tag(raw, at, end)
            width = struct.unpack_from(end + "i", raw, data)[0]
            _, size, data, at = tag(raw, at, end)
            fields = [bytes(raw[k : k + width]).split(b"\0")[0].decode("latin1") for k in range(data, data + size, width)]
        rows = []
        for _ in range(count):
            row = {}
            for f in fields:
                _, size, data, after = tag(raw, at, end)
                row[f] = matrix(raw, data, end)[1] if size else ""
                at = after
            rows.append(row)
        return name, [r[""] for r in rows] if kind == CELL else rows
    stored, size, data, _ = tag(raw, at, end)
    value = Stored(raw, data, size, end + STORED[stored], shape)
    if kind == CHAR:
        flat = np.frombuffer(raw, end + STORED[stored], size // np.dtype(STORED[stored]).itemsize, data)
        return name, bytes(flat.astype("u1")).decode("utf-8") if stored == 16 else "".join(map(chr, flat.reshape(shape, order="F").ravel() if len(flat) == count else flat))
    return name, value


def elements(raw: bytes) -> dict[str, object]:
    """The file's variables by name: lists of rows for structures, lists for cells, texts, and Stored numbers."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT-file of version 5")
    end, at, out = "<" if raw[126:128] == b"IM" else ">", 128, {}
    while at + 8 <= len(raw):
        kind, size, data, after = tag(raw, at, end)
        if kind == COMPRESSED:
            inner = zlib.decompress(raw[data : data + size])
            kind, _, start, _ = tag(inner, 0, end)
            name, value = matrix(inner, start, end) if kind == MATRIX else ("", None)
        else:
            name, value = matrix(raw, data, end) if kind == MATRIX and size else ("", None)
        if name:
            out[name] = value
        at = after
    return out
