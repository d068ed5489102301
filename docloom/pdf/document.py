"""A document: cross references, revisions, objects, pages, forms."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from docloom.functions import codecs
from docloom.pdf import crypto
from docloom.pdf.syntax import Keyword, Name, DocError, Reader, Ref, Stream, text_of

_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-zA-Z])")


def unpredict(data: bytes, p: dict) -> bytes:
    """Undo a row predictor (difference rows and the five row filters)."""
    kind = p.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, above = bytearray(), bytes(width)
    if kind == 2:
        for i in range(0, len(data), width):
            row = bytearray(data[i : i + width])
            for k in range(step, len(row)):
                row[k] = (row[k] + row[k - step]) & 255
            out += row
        return bytes(out)
    for i in range(0, len(data), width + 1):
        tag, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for k in range(len(row)):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            if tag == 4:
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                add = a if pa <= pb and pa <= pc else b if pb <= pc else c
            else:
                add = (0, a, b, (a + b) // 2)[tag] if tag < 4 else 0
            row[k] = (row[k] + add) & 255
        out += row
        above = bytes(row) + bytes(width - len(row))
    return bytes(out)


class Document:
    """An opened document. Unreadable parts become entries of ``warnings``."""

    def __init__(self, data: bytes, password: bytes = b""):
        if len(data) < 8:
            raise DocError("too_short", f"{len(data)} bytes")
        m = re.search(rb"%PDF-(\d+\.\d+)", data[:1024])
        if not m:
            raise DocError("no_header")
        self.data, self.version, self.warnings = data, m[1].decode(), []
        self.sections: list[dict] = []
        self.trailer: dict = {}
        self._load_chain()
        self.entries: dict[int, tuple] = {}
        for s in reversed(self.sections):  # oldest first: the last writer wins
            self.entries.update(s["entries"])
        self._cache: dict[int, object] = {}
        self._packs: dict[int, list] = {}
        self.encryption, self.key = None, b""
        if self.trailer.get("Encrypt") is not None:
            self._unlock(password)

    # -- cross references

    def startxref(self) -> int:
        at = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref\s+(\d+)").match(self.data, at) if at >= 0 else None
        return int(m[1]) if m else -1

    def _load_chain(self) -> None:
        at, seen = self.startxref(), set()
        queue = [at]
        while queue:
            at = queue.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            try:
                s = self.read_section(at)
            except (DocError, ValueError, zlib.error, IndexError) as e:
                self.warnings.append(("xref", f"section at {at}: {e}"))
                continue
            self.sections.append(s)
            for k, v in s["trailer"].items():
                self.trailer.setdefault(k, v)
            queue += [v for k in ("XRefStm", "Prev") if isinstance(v := s["trailer"].get(k), int)]
        if not self.sections or self.trailer.get("Root") is None:
            self.warnings.append(("repair", "objects found by scanning"))
            self._scan()

    def _scan(self) -> None:
        entries = {int(m[1]): ("at", m.start(), int(m[2])) for m in _OBJ.finditer(self.data)}
        trailer: dict = {}
        for m in re.finditer(rb"trailer\s*(?=<<)", self.data):
            try:
                trailer.update(Reader(self.data, m.end()).value())
            except DocError:
                continue
        if "Root" not in trailer:
            for n, (_, at, _) in entries.items():
                if re.compile(rb".{0,400}?/Type\s*/Catalog", re.S).match(self.data, at):
                    trailer["Root"] = Ref(n, 0)
        if not entries:
            raise DocError("no_objects")
        self.sections.append({"offset": -1, "kind": "scan", "entries": entries, "trailer": trailer})
        self.trailer.update(trailer)

    def read_section(self, at: int) -> dict:
        r = Reader(self.data, at)
        r.gap()
        if not self.data.startswith(b"xref", r.at):
            return self._stream_section(at)
        r.at += 4
        entries: dict[int, tuple] = {}
        while True:
            head = r.value(refs=False)
            if head == b"trailer":
                break
            count = r.value(refs=False)
            if not isinstance(head, int) or not isinstance(count, int):
                raise DocError("xref", "bad subsection")
            for n in range(head, head + count):
                offset, gen, kind = r.value(False), r.value(False), r.value(False)
                entries[n] = ("at", offset, gen) if kind == b"n" else ("free", offset, gen)
        return {"offset": at, "kind": "table", "entries": entries, "trailer": r.value()}

    def _stream_section(self, at: int) -> dict:
        _, _, s = self.object_at(at)
        if not isinstance(s, Stream):
            raise DocError("xref", "no stream")
        data, w = self.decode(s), s.attrs["W"]
        index = s.attrs.get("Index") or [0, s.attrs["Size"]]
        numbers = [n for a, b in zip(index[::2], index[1::2], strict=True) for n in range(a, a + b)]
        size, entries = sum(w), {}
        cut = [0, w[0], w[0] + w[1], size]
        for i, n in enumerate(numbers[: len(data) // size if size else 0]):
            row = data[i * size : (i + 1) * size]
            kind, a, b = (int.from_bytes(row[cut[k] : cut[k + 1]], "big") for k in range(3))
            kind = kind if w[0] else 1
            entries[n] = ("free", a, b) if kind == 0 else ("at", a, b) if kind == 1 else ("in", a, b)
        return {"offset": at, "kind": "stream", "entries": entries, "trailer": s.attrs}

    # -- objects

    def object_at(self, at: int) -> tuple[int, int, object]:
        """(number, generation, value) of the object whose header is at, or within 100 bytes of, this place."""
        m = re.compile(rb"[\0\t\n\f\r ]*" + _OBJ.pattern).match(self.data, at) or _OBJ.search(self.data, max(0, at - 100), at + 100)
        if not m:
            raise DocError("no_object", f"at {at}")
        r = Reader(self.data, m.end())
        v = r.value()
        end = r.at
        r.gap()
        if isinstance(v, dict) and self.data.startswith(b"stream", r.at):
            start = r.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
            n = v.get("Length")
            n = self.obj(n[0]) if isinstance(n, Ref) and n[0] != int(m[1]) else n
            if not isinstance(n, int) or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, start + n):
                stop = self.data.find(b"endstream", start)
                stop = len(self.data) if stop < 0 else stop
                n = len(self.data[start:stop].rstrip(b"\r\n"))
            v, end = Stream(v, self.data[start : start + n]), start + n
        self.last_end = end
        return int(m[1]), int(m[2]), v

    def obj(self, num: int):
        """The value of an object, decrypted; None if it is free, missing or unreadable."""
        if num in self._cache:
            return self._cache[num]
        self._cache[num] = None  # a cycle of lengths ends here
        e = self.entries.get(num)
        v = None
        try:
            if e and e[0] == "at":
                n, gen, v = self.object_at(e[1])
                if n != num:
                    m = next((m for m in _OBJ.finditer(self.data) if int(m[1]) == num), None)
                    n, gen, v = self.object_at(m.start()) if m else (num, 0, None)
                v = self._decrypted(v, num, gen)
            elif e and e[0] == "in":
                pack = self._pack(e[1])
                v = pack[e[2]][1] if e[2] < len(pack) and pack[e[2]][0] == num else dict(pack).get(num)
        except (DocError, ValueError, KeyError, IndexError) as err:
            self.warnings.append(("object", f"{num}: {err}"))
        self._cache[num] = v
        return v

    def _pack(self, num: int) -> list:
        if num not in self._packs:
            s = self.obj(num)
            data, first = self.decode(s), s.attrs["First"]
            r = Reader(data)
            heads = [(r.value(False), r.value(False)) for _ in range(s.attrs["N"])]
            self._packs[num] = [(n, Reader(data, first + off).value()) for n, off in heads]
        return self._packs[num]

    def get(self, v):
        """Follows references."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.obj(v[0])
        return None

    def decode(self, s: Stream) -> bytes:
        filters, params = self.get(s.attrs.get("Filter")), self.get(s.attrs.get("DecodeParms"))
        filters = [] if filters is None else [filters] if isinstance(filters, Name) else filters
        params = params if isinstance(params, list) else [params] * len(filters)
        data = s.raw
        for f, p in zip(filters, [*params, *[None] * len(filters)], strict=False):
            f, p = self.get(f), self.get(p)
            if f in ("FlateDecode", "Fl"):
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    data = codecs.inflate_any(data)[0]
                data = unpredict(data, p or {})
            elif f in codecs.DECODERS and f not in ("DCTDecode", "DCT"):
                data = codecs.decode_filter(data, f)
        return data

    # -- encryption

    def _unlock(self, password: bytes) -> None:
        d = self.get(self.trailer["Encrypt"])
        if not isinstance(d, dict):
            raise DocError("bad_encryption")
        v, r = d.get("V", 0), d.get("R", 2)
        method = {1: "V2", 2: "V2", 3: "V2"}.get(v, "V2")
        if v >= 4:
            cf = (d.get("CF") or {}).get(d.get("StmF", "Identity"), {})
            method = cf.get("CFM", "Identity" if v == 4 else "AESV3")
        self.encryption = {"v": v, "r": r, "length": 128 if v == 4 else d.get("Length", 40), "p": d.get("P", 0), "o": d.get("O", b""), "u": d.get("U", b""), "oe": d.get("OE", b""), "ue": d.get("UE", b""), "metadata": d.get("EncryptMetadata", True), "method": method}
        self.key = crypto.unlock(self.encryption, self.file_id(), password)
        self._cache.clear()
        if isinstance(self.trailer["Encrypt"], Ref):
            self._cache[self.trailer["Encrypt"][0]] = d

    def file_id(self) -> bytes:
        ids = self.get(self.trailer.get("ID"))
        return ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""

    def _decrypted(self, v, num: int, gen: int):
        if not self.key:
            return v
        if isinstance(v, Stream):
            if v.attrs.get("Type") == "XRef" or v.attrs.get("Type") == "Metadata" and not self.encryption["metadata"]:
                return v
            return Stream(self._decrypted(v.attrs, num, gen), crypto.apply(self.key, self.encryption, num, gen, v.raw, True))
        if isinstance(v, dict):
            return {k: self._decrypted(x, num, gen) for k, x in v.items()}
        if isinstance(v, list):
            return [self._decrypted(x, num, gen) for x in v]
        if isinstance(v, bytes) and not isinstance(v, Keyword):
            return crypto.apply(self.key, self.encryption, num, gen, v, True)
        return v

    # -- revisions

    def revisions(self) -> list[dict]:
        """Byte ranges that end with an end-of-file mark, oldest first."""
        out, start = [], 0
        for i, m in enumerate(re.finditer(rb"%%EOF", self.data)):
            x = list(re.finditer(rb"startxref\s+(\d+)", self.data[start : m.start()]))
            out.append({"rev": i + 1, "start_offset": start, "eof_offset": m.start(), "end_offset": m.end(), "startxref": int(x[-1][1]) if x else -1})
            start = m.end()
        return out

    def raw_objects(self) -> list[dict]:
        """Every object of every revision with its exact bytes."""
        out = []
        for r in self.revisions() or [{"rev": 1, "start_offset": 0, "end_offset": len(self.data)}]:
            at = r["start_offset"]
            while (m := _OBJ.search(self.data, at, r["end_offset"])) is not None:
                stop = self.data.find(b"endobj", m.end(), r["end_offset"])
                try:
                    v = self.object_at(m.start())[2]
                    stop = self.data.find(b"endobj", self.last_end, r["end_offset"])
                except DocError:
                    v = None
                end = stop + 6 if stop >= 0 else r["end_offset"]
                out.append({"rev": r["rev"], "obj_num": int(m[1]), "gen": int(m[2]), "offset": m.start(), "end_offset": end, "raw": self.data[m.start() : end], "is_stream": isinstance(v, Stream)})
                at = end
        return out

    # -- document structure

    @lru_cache(maxsize=4)  # noqa: B019
    def pages(self) -> list[tuple[int, dict]]:
        """(object number, attributes with inherited ones) in reading order; cycles end."""
        root = self.get(self.trailer.get("Root")) or {}
        out, seen = [], set()

        def walk(ref, above: dict) -> None:
            if isinstance(ref, Ref):
                if ref[0] in seen:
                    return
                seen.add(ref[0])
            d = self.get(ref)
            if not isinstance(d, dict):
                return
            own = above | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list) and d.get("Type") != "Page":
                for k in kids:
                    walk(k, own)
            else:
                out.append((ref[0] if isinstance(ref, Ref) else 0, own | d))

        walk(root.get("Pages"), {})
        return out

    def metadata(self) -> dict:
        info = self.get(self.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        names = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modified_date"}
        out = {v: text_of(self.get(info.get(k))) for k, v in names.items()}
        custom = {k: text_of(self.get(v)) for k, v in info.items() if k not in names and k != "Trapped"}
        return out | {"version": self.version, "page_count": len(self.pages()), "encrypted": self.encryption is not None, "custom": custom}

    def outline(self) -> list[dict]:
        root = self.get(self.trailer.get("Root")) or {}
        numbers = {n: i + 1 for i, (n, _) in enumerate(self.pages())}
        out, seen = [], set()

        def walk(ref, parent: int | None, depth: int) -> None:
            ordinal = 0
            while isinstance(ref, Ref) and ref[0] not in seen:
                seen.add(ref[0])
                d = self.get(ref)
                if not isinstance(d, dict):
                    return
                action = self.get(d.get("A")) or {}
                dest = self.get(d.get("Dest")) or self.get(action.get("D"))
                page = numbers.get(dest[0][0]) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None
                out.append({"node_id": ref[0], "parent_id": parent, "ordinal": ordinal, "depth": depth, "title": text_of(self.get(d.get("Title"))), "page": page, "uri": text_of(self.get(action.get("URI"))) or None})
                walk(d.get("First"), ref[0], depth + 1)
                ref, ordinal = d.get("Next"), ordinal + 1

        walk((self.get(root.get("Outlines")) or {}).get("First"), None, 0)
        return out

    def annotations(self) -> list[dict]:
        out = []
        for page, (_, attrs) in enumerate(self.pages(), 1):
            for ref in self.get(attrs.get("Annots")) or []:
                d = self.get(ref)
                if not isinstance(d, dict):
                    continue
                action = self.get(d.get("A")) or {}
                out.append({"page": page, "obj_num": ref[0] if isinstance(ref, Ref) else None, "subtype": str(d.get("Subtype", "")), "rect": [float(x) for x in self.get(d.get("Rect")) or []], "contents": text_of(self.get(d.get("Contents"))), "uri": text_of(self.get(action.get("URI"))) or None, "color": [float(x) for x in self.get(d.get("C")) or []], "quads": [float(x) for x in self.get(d.get("QuadPoints")) or []]})
        return out

    # -- forms

    def form(self) -> dict:
        root = self.get(self.trailer.get("Root")) or {}
        form = self.get(root.get("AcroForm"))
        return form if isinstance(form, dict) else {}

    def fields(self) -> list[dict]:
        """Form fields with inherited attributes and full names, kids after their parents."""
        out, seen = [], set()

        def walk(ref, parent: dict | None) -> None:
            num = ref[0] if isinstance(ref, Ref) else None
            d = self.get(ref)
            if num in seen or not isinstance(d, dict):
                return
            seen.add(num)
            part = text_of(self.get(d.get("T")))
            own = {k: self.get(d[k]) for k in ("FT", "Ff", "V", "DV", "MaxLen", "Opt") if k in d}
            have = ({k: parent[k] for k in ("FT", "Ff", "V", "DV", "MaxLen", "Opt") if k in parent} if parent else {}) | own
            name = ".".join(x for x in ((parent or {}).get("full_name", ""), part) if x)
            kids = [k for k in self.get(d.get("Kids")) or []]
            row = have | {"obj_num": num, "parent_obj": (parent or {}).get("obj_num"), "t": part, "full_name": name, "tu": text_of(self.get(d.get("TU"))), "rect": [float(x) for x in self.get(d.get("Rect")) or []], "terminal": not any("T" in (self.get(k) or {}) for k in kids)}
            out.append(row)
            for k in kids:
                if "T" in (self.get(k) or {}):
                    walk(k, row)

        for ref in self.get(self.form().get("Fields")) or []:
            walk(ref, None)
        return out

    def xfa_packets(self) -> list[dict]:
        xfa = self.get(self.form().get("XFA"))
        if isinstance(xfa, Stream):
            return [{"name": "xdp", "data": self.decode(xfa), "obj_num": None}]
        pairs = zip(xfa[::2], xfa[1::2], strict=False) if isinstance(xfa, list) else ()
        return [{"name": text_of(n), "data": self.decode(s), "obj_num": r[0] if isinstance(r, Ref) else None} for n, r in pairs if isinstance(s := self.get(r), Stream)]
