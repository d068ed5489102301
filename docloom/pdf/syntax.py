"""Objects of the document syntax: reading and writing values."""

from __future__ import annotations

import re

SPACE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_GAP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


class DocError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


class Name(str):
    """A name object, without its slash."""


class Keyword(bytes):
    """An operator or any other bare word."""


class Ref(tuple):
    """A reference (object number, generation)."""

    def __new__(cls, num: int, gen: int = 0):
        return super().__new__(cls, (num, gen))


class Stream:
    def __init__(self, attrs: dict, raw: bytes):
        self.attrs, self.raw = attrs, raw


class Reader:
    """Reads values from bytes at a moving position."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def gap(self) -> None:
        self.at = _GAP.match(self.data, self.at).end()

    def value(self, refs: bool = True, depth: int = 0):
        """The next value; None at the end raises, a null object is None."""
        if depth > 200:
            raise DocError("syntax", "nested too deeply")
        self.gap()
        d, i = self.data, self.at
        if i >= len(d):
            raise DocError("syntax", "end of data")
        c = d[i]
        if c == 0x2F:
            m = _TOKEN.match(d, i + 1)
            self.at = m.end() if m else i + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if c == 0x28:
            return self._literal()
        if d.startswith(b"<<", i):
            self.at = i + 2
            out: dict = {}
            while True:
                self.gap()
                if d.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.value(refs, depth + 1)
                if not isinstance(key, Name):
                    if self.at >= len(d):
                        raise DocError("syntax", "unclosed dictionary")
                    continue
                self.gap()
                if d.startswith(b">>", self.at):
                    out[key] = None
                    continue
                out[key] = self.value(refs, depth + 1)
        if c == 0x3C:
            end = d.find(b">", i)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[i + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at = i + 1
            items: list = []
            while True:
                self.gap()
                if self.at >= len(d):
                    return items
                if d[self.at] == 0x5D:
                    self.at += 1
                    return items
                items.append(self.value(refs, depth + 1))
        if refs and 0x30 <= c <= 0x39 and (m := _REF.match(d, i)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _TOKEN.match(d, i)
        if not m:
            self.at = i + 1
            return Keyword(d[i : i + 1])
        self.at = m.end()
        word = m[0]
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Keyword(word))

    def _literal(self) -> bytes:
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            c = d[i]
            if c == 0x5C:
                i += 1
                e = d[i : i + 1]
                if e in b"01234567" and e:
                    m = re.compile(rb"[0-7]{1,3}").match(d, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if e == b"\r":
                    i += 2 if d[i + 1 : i + 2] == b"\n" else 1
                    continue
                if e != b"\n":
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                i += 1
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
            i += 1
        self.at = i + 1
        return bytes(out)


def write_value(v) -> bytes:
    """A value as document syntax; names in dictionaries stand in order."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], v.encode("latin-1", "replace"))
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, Keyword):
        return bytes(v)
    if isinstance(v, str):
        v = v.encode("latin-1") if all(ord(c) < 128 for c in v) else b"\xfe\xff" + v.encode("utf-16-be")
    if isinstance(v, bytes):
        if any(c < 32 and c not in (9, 10, 13) or c > 126 for c in v):
            return b"<" + v.hex().upper().encode() + b">"
        for raw, safe in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n"), (b"\t", b"\\t")):
            v = v.replace(raw, safe)
        return b"(" + v + b")"
    if isinstance(v, (list,)):
        return b"[" + b" ".join(map(write_value, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(write_value(Name(k)) + b" " + write_value(v[k]) for k in sorted(v)) + b">>"
    if isinstance(v, Stream):
        return write_value(v.attrs | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise DocError("syntax", f"can't write {type(v).__name__}")


def text_of(v) -> str:
    """A string object as text: UTF-16 or UTF-8 by its mark, else Latin-1 in its document variant."""
    if not isinstance(v, bytes):
        return "" if v is None else str(v)
    if v[:2] == b"\xfe\xff":
        return v[2:].decode("utf-16-be", "replace")
    if v[:3] == b"\xef\xbb\xbf":
        return v[3:].decode("utf-8", "replace")
    return v.decode("latin-1")
