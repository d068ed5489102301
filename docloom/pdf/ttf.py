"""TrueType files: tables, metrics, character map, subsets, embedding."""

from __future__ import annotations

import struct
import zlib

from docloom.pdf.syntax import Name, DocError, Ref, Stream


class TrueType:
    def __init__(self, data: bytes):
        if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
            raise DocError("bad_font", "unknown signature")
        self.data = data
        n = struct.unpack(">H", data[4:6])[0]
        self.tables = {}
        for i in range(n):
            tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * i : 28 + 16 * i])
            self.tables[tag.decode("latin-1")] = data[at : at + size]
        for t in ("head", "maxp", "hhea", "hmtx", "cmap"):
            if t not in self.tables:
                raise DocError("bad_font", f"no {t}")
        head, hhea = self.tables["head"], self.tables["hhea"]
        self.units = struct.unpack(">H", head[18:20])[0]
        self.box = struct.unpack(">4h", head[36:44])
        self.ascent, self.descent = struct.unpack(">2h", hhea[4:8])
        self.glyphs = struct.unpack(">H", self.tables["maxp"][4:6])[0]
        long = struct.unpack(">H", hhea[34:36])[0]
        hmtx = self.tables["hmtx"]
        self.advances = [struct.unpack(">H", hmtx[4 * i : 4 * i + 2])[0] for i in range(long)]
        self.italic = struct.unpack(">i", self.tables["post"][4:8])[0] / 65536 if len(self.tables.get("post", b"")) >= 8 else 0.0
        self.cmap = self._cmap()
        self.name = self._name(6) or self._name(4) or "Font"

    def _name(self, wanted: int) -> str:
        t = self.tables.get("name", b"")
        if len(t) < 6:
            return ""
        _, n, base = struct.unpack(">3H", t[:6])
        for i in range(n):
            platform, _, _, kind, size, at = struct.unpack(">6H", t[6 + 12 * i : 18 + 12 * i])
            if kind == wanted:
                return t[base + at : base + at + size].decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
        return ""

    def _cmap(self) -> dict[int, int]:
        t, out = self.tables["cmap"], {}
        for i in range(struct.unpack(">H", t[2:4])[0]):
            at = struct.unpack(">I", t[8 + 8 * i : 12 + 8 * i])[0]
            form = struct.unpack(">H", t[at : at + 2])[0]
            if form == 4:
                n = struct.unpack(">H", t[at + 6 : at + 8])[0] // 2
                row = lambda k, n=n, at=at: struct.unpack(f">{n}H", t[at + 14 + k : at + 14 + k + 2 * n])
                ends, starts, deltas, offsets = row(0), row(2 * n + 2), row(4 * n + 2), row(6 * n + 2)
                for s, (a, z, d, o) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
                    for c in range(a, min(z, 0xFFFE) + 1):
                        g = c
                        if o:
                            p = at + 14 + 6 * n + 2 + 2 * s + o + 2 * (c - a)
                            g = struct.unpack(">H", t[p : p + 2])[0] if p + 2 <= len(t) else 0
                            if not g:
                                continue
                        out.setdefault(c, (g + d) & 0xFFFF)
            elif form == 12:
                for k in range(struct.unpack(">I", t[at + 12 : at + 16])[0]):
                    a, z, g = struct.unpack(">3I", t[at + 16 + 12 * k : at + 28 + 12 * k])
                    out.update({c: g + c - a for c in range(a, min(z, a + 0x10FFFF) + 1)})
        return out

    def advance(self, glyph: int) -> int:
        return self.advances[min(glyph, len(self.advances) - 1)]

    def width(self, text: str, size: float) -> float:
        return sum(self.advance(self.cmap.get(ord(c), 0)) for c in text) * size / self.units

    def subset(self, text: str) -> list[int]:
        """Glyphs of the printable characters of a text, and glyph 0, in order."""
        return sorted({0, *(self.cmap[ord(c)] for c in text if c.isprintable() and ord(c) in self.cmap)})

    def to_unicode(self, text: str) -> bytes:
        pairs = sorted({(self.cmap[ord(c)], c) for c in text if ord(c) in self.cmap})
        out = ["/CIDInit /ProcSet findresource begin 12 dict begin begincmap", "1 begincodespacerange <0000> <FFFF> endcodespacerange"]
        for i in range(0, len(pairs), 100):
            part = pairs[i : i + 100]
            out += [f"{len(part)} beginbfchar", *(f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in part), "endbfchar"]
        return "\n".join([*out, "endcmap end end"]).encode()

    def objects(self, text: str, first: int) -> dict[int, object]:
        """Font objects for the characters of a text, numbered from ``first`` (the font itself)."""
        scale = 1000 / self.units
        widths = [x for g in self.subset(text) for x in (g, [round(self.advance(g) * scale)])]
        name = Name(self.name.replace(" ", ""))
        return {
            first: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": name, "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(first + 1)], "ToUnicode": Ref(first + 4)},
            first + 1: {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": name, "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": Ref(first + 2), "W": widths, "CIDToGIDMap": Name("Identity")},
            first + 2: {"Type": Name("FontDescriptor"), "FontName": name, "Flags": 32, "FontBBox": [round(x * scale) for x in self.box], "ItalicAngle": self.italic, "Ascent": round(self.ascent * scale), "Descent": round(self.descent * scale), "CapHeight": round(self.ascent * scale), "StemV": 80, "FontFile2": Ref(first + 3)},
            first + 3: Stream({"Filter": Name("FlateDecode"), "Length1": len(self.data)}, zlib.compress(self.data)),
            first + 4: Stream({}, self.to_unicode(text)),
        }

    def encode(self, text: str) -> bytes:
        """A text as two-byte glyph codes."""
        return b"".join(struct.pack(">H", self.cmap.get(ord(c), 0)) for c in text)
