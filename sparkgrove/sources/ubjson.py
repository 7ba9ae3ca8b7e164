"""Universal Binary JSON (draft 12): null, booleans, integers, doubles, strings, arrays
and objects, big-endian. Numbers are written in the smallest integer type, or as doubles."""

from __future__ import annotations

import struct

#: markers of integer types with their range and format (fixed values of the format)
INTEGERS = ((b"i", -128, 127, ">b"), (b"U", 0, 255, ">B"), (b"I", -(2**15), 2**15 - 1, ">h"), (b"l", -(2**31), 2**31 - 1, ">i"), (b"L", -(2**63), 2**63 - 1, ">q"))
REALS = {b"d": ">f", b"D": ">d"}
_FORMATS = {mark: fmt for mark, _, _, fmt in INTEGERS} | REALS


def _integer(x: int) -> bytes:
    for mark, low, high, fmt in INTEGERS:
        if low <= x <= high:
            return mark + struct.pack(fmt, x)
    raise ValueError(f"{x} needs more than 64 bits")


def _text(x: str) -> bytes:
    raw = x.encode()
    return _integer(len(raw)) + raw


def dumps(x) -> bytes:
    if x is None:
        return b"Z"
    if isinstance(x, bool):
        return b"T" if x else b"F"
    if isinstance(x, int):
        return _integer(x)
    if isinstance(x, float):
        return b"D" + struct.pack(">d", x)
    if isinstance(x, str):
        return b"S" + _text(x)
    if isinstance(x, (list, tuple)):
        return b"[" + b"".join(map(dumps, x)) + b"]"
    if isinstance(x, dict):
        return b"{" + b"".join(_text(str(k)) + dumps(v) for k, v in x.items()) + b"}"
    raise TypeError(f"no form for {type(x).__name__}")


class _Reader:
    """Reads one value; arrays and objects may carry a type and a count, as other writers' do."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        got = self.raw[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("the data end within a value")
        self.at += n
        return got

    def mark(self) -> bytes:
        while (m := self.take(1)) == b"N":
            pass
        return m

    def number(self, m: bytes):
        fmt = _FORMATS.get(m)
        if not fmt:
            raise ValueError(f"unknown marker {m!r} at byte {self.at - 1}")
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def text(self, m: bytes | None = None) -> str:
        return self.take(self.number(m or self.mark())).decode()

    def head(self) -> tuple[bytes | None, int | None]:
        kind = count = None
        if self.raw[self.at : self.at + 1] == b"$":
            self.at += 1
            kind = self.take(1)
        if self.raw[self.at : self.at + 1] == b"#":
            self.at += 1
            count = self.number(self.mark())
        return kind, count

    def value(self, m: bytes | None = None):
        m = m or self.mark()
        if m in b"ZTF":
            return {b"Z": None, b"T": True, b"F": False}[m]
        if m == b"S":
            return self.text()
        if m == b"C":
            return self.take(1).decode()
        if m == b"[":
            kind, count = self.head()
            if kind in _FORMATS and count is not None:  # numbers of one type lie side by side
                fmt = _FORMATS[kind]
                return list(struct.unpack(f">{count}{fmt[1]}", self.take(count * struct.calcsize(fmt))))
            out = []
            while count is None or len(out) < count:
                if count is None and (m := self.mark()) == b"]":
                    break
                out.append(self.value(kind or (m if count is None else None)))
            return out
        if m == b"{":
            kind, count = self.head()
            out, n = {}, 0
            while count is None or n < count:
                if (m := self.mark()) == b"}" and count is None:
                    break
                key = self.text(m)
                out[key] = self.value(kind)
                n += 1
            return out
        return self.number(m)


def loads(raw: bytes):
    return _Reader(bytes(raw)).value()
