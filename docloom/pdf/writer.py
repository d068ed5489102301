"""Writing: whole documents, appended revisions, page sets, and a builder for simple pages."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import struct
import zlib

import numpy as np

from docloom.functions import xfa
from docloom.pdf import crypto
from docloom.pdf.document import Document, unpredict
from docloom.pdf.syntax import Name, DocError, Ref, Stream, write_value


def write(objects: dict[int, object], trailer: dict, version: str = "1.7", xref_stream: bool = False, pack: bool = False, encryption: tuple[dict, bytes] | None = None, random=None) -> bytes:
    """A document of these objects in number order, with a table or a stream of cross references.

    ``pack``: objects that are no streams go into an object stream (needs ``xref_stream``).
    ``encryption``: description and key from ``crypto.setup``.
    """
    objects = dict(objects)
    trailer = dict(trailer)
    if "ID" not in trailer:
        d = hashlib.md5(b"".join(write_value(v) for _, v in sorted(objects.items()))).digest()
        trailer["ID"] = [d, d]
    lock = None
    if encryption:
        e, key = encryption
        top = max(objects, default=0) + 1
        objects[top] = encryption_dict(e)
        trailer["Encrypt"] = Ref(top)
        lock = (top, e, key)
    entries: dict[int, tuple[int, int, int]] = {}
    if pack and xref_stream:
        inner = [n for n, v in sorted(objects.items()) if not isinstance(v, Stream) and not (lock and n == lock[0])]
        bodies = [write_value(objects[n]) for n in inner]
        heads, at = [], 0
        for n, b in zip(inner, bodies, strict=True):
            heads.append(f"{n} {at}")
            at += len(b) + 1
        head = (" ".join(heads) + "\n").encode()
        holder = max(objects) + 1
        for i, n in enumerate(inner):
            entries[n] = (2, holder, i)
            del objects[n]
        objects[holder] = Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b"\n".join(bodies)))
    out = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n")
    for n, v in sorted(objects.items()):
        entries[n] = (1, len(out), 0)
        if lock and n != lock[0]:
            v = locked(v, n, lock[1], lock[2], random)
        out += b"%d 0 obj\n" % n + write_value(v) + b"\nendobj\n"
    return bytes(out) + _xref(len(out), entries, trailer, xref_stream, True)


def _xref(at: int, entries: dict, trailer: dict, as_stream: bool, whole: bool) -> bytes:
    out = bytearray()
    if as_stream:
        top = max(entries, default=0) + 1
        entries = entries | {top: (1, at, 0)} | ({0: (0, 0, 65535)} if whole else {})
    size = max([*entries, 0]) + 1
    runs: list[list[int]] = []
    for n in sorted(entries if as_stream else entries | ({0: (0, 0, 65535)} if whole else {})):
        if runs and runs[-1][-1] == n - 1:
            runs[-1].append(n)
        else:
            runs.append([n])
    trailer = trailer | {"Size": max(size, trailer.get("Size", 0) if not whole else 0)}
    if as_stream:
        widths = [1, max(1, (max(e[1] for e in entries.values()).bit_length() + 7) // 8), 2]
        rows = b"".join(b"".join(x.to_bytes(w, "big") for x, w in zip(entries[n], widths, strict=True)) for r in runs for n in r)
        s = Stream(trailer | {"Type": Name("XRef"), "W": widths, "Index": [x for r in runs for x in (r[0], len(r))], "Filter": Name("FlateDecode")}, zlib.compress(rows))
        out += b"%d 0 obj\n" % top + write_value(s) + b"\nendobj\n"
    else:
        out += b"xref\n"
        for r in runs:
            out += b"%d %d\n" % (r[0], len(r))
            for n in r:
                out += b"0000000000 65535 f \n" if n == 0 else b"%010d %05d n \n" % entries[n][1:]
        out += b"trailer\n" + write_value(trailer) + b"\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at


def encryption_dict(e: dict) -> dict:
    d = {"Filter": Name("Standard"), "V": e["v"], "R": e["r"], "O": e["o"], "U": e["u"], "P": e["p"], "Length": e["length"]}
    if e["v"] >= 4:
        d |= {"CF": {"StdCF": {"CFM": Name(e["method"]), "AuthEvent": Name("DocOpen"), "Length": e["length"] // 8}}, "StmF": Name("StdCF"), "StrF": Name("StdCF"), "EncryptMetadata": e["metadata"]}
    if e["v"] >= 5:
        d |= {"OE": e["oe"], "UE": e["ue"], "Perms": e["perms"]}
    return d


def locked(v, num: int, e: dict, key: bytes, random=None):
    iv = (lambda: random(16)) if random else (lambda: None)
    if isinstance(v, Stream):
        if v.attrs.get("Type") == "XRef":
            return v
        return Stream(locked(v.attrs, num, e, key, random), crypto.apply(key, e, num, 0, v.raw, False, iv()))
    if isinstance(v, dict):
        return {k: locked(x, num, e, key, random) for k, x in v.items()}
    if isinstance(v, list):
        return [locked(x, num, e, key, random) for x in v]
    if isinstance(v, str) and not isinstance(v, Name):
        v = v.encode("latin-1") if v.isascii() else b"\xfe\xff" + v.encode("utf-16-be")
    if isinstance(v, bytes):
        return crypto.apply(key, e, num, 0, v, False, iv())
    return v


def append_revision(data: bytes, changed: dict[int, object]) -> bytes:
    """The same bytes with a revision behind them in which these objects are new."""
    doc = Document(data)
    if doc.encryption:
        raise DocError("encrypted", "unlock and write anew")
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    entries = {}
    for n, v in sorted(changed.items()):
        entries[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + write_value(v) + b"\nendobj\n"
    trailer = {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer} | {"Prev": doc.startxref(), "Size": max([*doc.entries, *changed]) + 1}
    kind = doc.sections[0]["kind"] == "stream"
    return bytes(out) + _xref(len(out), entries, trailer, kind, False)


# -- page sets


def _refs(v):
    if isinstance(v, Ref):
        yield v[0]
    elif isinstance(v, Stream):
        yield from _refs(v.attrs)
    elif isinstance(v, dict):
        for x in v.values():
            yield from _refs(x)
    elif isinstance(v, list):
        for x in v:
            yield from _refs(x)


def _renumbered(v, to: dict[int, int]):
    if isinstance(v, Ref):
        return Ref(to[v[0]]) if v[0] in to else None
    if isinstance(v, Stream):
        return Stream(_renumbered(v.attrs, to), v.raw)
    if isinstance(v, dict):
        return {k: _renumbered(x, to) for k, x in v.items()}
    if isinstance(v, list):
        return [_renumbered(x, to) for x in v]
    return v


def _labels(doc: Document, tree, pages: list[int | None]) -> dict:
    """Page labels of these pages (from 0; None has no label), one entry each."""
    starts, todo, seen = {}, [tree], set()
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            if v[0] in seen:
                continue
            seen.add(v[0])
        d = doc.get(v)
        if isinstance(d, dict):
            flat = doc.get(d.get("Nums")) or []
            starts |= {doc.get(k): doc.get(x) or {} for k, x in zip(flat[::2], flat[1::2], strict=False)}
            todo += doc.get(d.get("Kids")) or []
    order, out = sorted(starts), []
    for i, p in enumerate(pages):
        at = bisect.bisect_right(order, p) - 1 if p is not None else -1
        label = starts[order[at]] if at >= 0 else {}
        out += [i, label | {"St": (doc.get(label.get("St")) or 1) + p - order[at]} if label else {}]
    return {"Nums": out}


def assemble(sources: list[tuple[bytes, bytes]], wanted: list[tuple[int, int, int]], edited: int | None = None) -> bytes:
    """A document of pages (source, page number, extra rotation) with all that they refer to.

    ``edited``: the source of which the document is an edit. Its metadata, outline, form and other
    entries of the catalog stay, as does its version; destinations on pages that are gone become null.
    """
    docs = [Document(d, p) for d, p in sources]
    objects: dict[int, object] = {1: None, 2: None}
    maps: list[dict[int, int]] = [{} for _ in docs]
    numbers = [{n for n, _ in doc.pages()} for doc in docs]
    kids = []

    def carry(s: int, value) -> None:
        todo = list(_refs(value))
        while todo:
            n = todo.pop()
            if n in maps[s] or n in numbers[s]:
                continue
            v = docs[s].obj(n)
            if isinstance(v, dict) and v.get("Type") in ("Pages", "Catalog"):
                continue
            maps[s][n] = new = len(objects) + 1
            objects[new] = (s, v)
            todo += list(_refs(v))

    shown: list[dict[int, int]] = [{} for _ in docs]
    for s, page, turn in wanted:
        pages = docs[s].pages()
        if not 1 <= page <= len(pages):
            raise DocError("no_page", str(page))
        attrs = {k: v for k, v in pages[page - 1][1].items() if k != "Parent"}
        carry(s, attrs)
        new = len(objects) + 1
        objects[new] = (s, attrs | {"Type": Name("Page"), "Rotate": ((attrs.get("Rotate") or 0) + turn) % 360})
        kids.append(new)
        shown[s].setdefault(pages[page - 1][0], new)
    objects[1], trailer, version = {}, {"Root": Ref(1)}, "1.7"
    if edited is not None:
        doc, version = docs[edited], docs[edited].version
        root = {k: v for k, v in (doc.get(doc.trailer.get("Root")) or {}).items() if k not in ("Type", "Pages")}
        from_edited = [p - 1 if s == edited else None for s, p, _ in wanted]
        if "PageLabels" in root and from_edited != list(range(len(doc.pages()))):
            root["PageLabels"] = _labels(doc, root["PageLabels"], from_edited)
        carry(edited, root)
        objects[1] = (edited, root)
        info = doc.get(doc.trailer.get("Info"))
        if isinstance(info, dict):
            carry(edited, info)
            trailer["Info"] = Ref(len(objects) + 1)
            objects[len(objects) + 1] = (edited, info)
        if doc.file_id():
            trailer["ID"] = doc.get(doc.trailer["ID"])
    to = [m | at for m, at in zip(maps, shown, strict=True)]
    for n, v in objects.items():
        if isinstance(v, tuple) and not isinstance(v, Ref):
            objects[n] = _renumbered(v[1], to[v[0]])
    for k in kids:
        objects[k]["Parent"] = Ref(2)
    objects[1] |= {"Type": Name("Catalog"), "Pages": Ref(2)}
    objects[2] = {"Type": Name("Pages"), "Kids": [Ref(k) for k in kids], "Count": len(kids)}
    return write(objects, trailer, version)


def merge(files: list[bytes], passwords: list[bytes] | None = None) -> bytes:
    passwords = passwords or [b""] * len(files)
    wanted = [(i, p, 0) for i, f in enumerate(files) for p in range(1, len(Document(f, passwords[i]).pages()) + 1)]
    return assemble(list(zip(files, passwords, strict=True)), wanted)


def split(data: bytes, ranges: list[tuple[int, int]], password: bytes = b"") -> list[bytes]:
    return [assemble([(data, password)], [(0, p, 0) for p in range(a, b + 1)]) for a, b in ranges]


def split_every(data: bytes, n: int, password: bytes = b"") -> list[bytes]:
    total = len(Document(data, password).pages())
    return split(data, [(a, min(total, a + n - 1)) for a in range(1, total + 1, n)], password)


def extract_pages(data: bytes, pages: list[int], password: bytes = b"") -> bytes:
    return assemble([(data, password)], [(0, p, 0) for p in pages])


def delete_pages(data: bytes, pages: list[int], password: bytes = b"") -> bytes:
    left = [p for p in range(1, len(Document(data, password).pages()) + 1) if p not in set(pages)]
    if not left:
        raise DocError("no_page", "a document keeps a page")
    return assemble([(data, password)], [(0, p, 0) for p in left], 0)


def insert_pages(data: bytes, at: int, other: bytes, password: bytes = b"") -> bytes:
    """Pages of another document before page ``at``; 0 or beyond the end appends."""
    n, m = len(Document(data, password).pages()), len(Document(other).pages())
    cut = n if at < 1 or at > n else at - 1
    return assemble([(data, password), (other, b"")], [(0, p, 0) for p in range(1, cut + 1)] + [(1, p, 0) for p in range(1, m + 1)] + [(0, p, 0) for p in range(cut + 1, n + 1)], 0)


def rotate_pages(data: bytes, angle: int, pages: list[int] | None = None, password: bytes = b"") -> bytes:
    if angle % 90:
        raise DocError("bad_angle", str(angle))
    n = len(Document(data, password).pages())
    return assemble([(data, password)], [(0, p, angle if pages is None or p in pages else 0) for p in range(1, n + 1)], 0)


# -- forms


def fill_form(data: bytes, values: dict[str, object]) -> tuple[bytes, list[str]]:
    """The document with an appended revision that holds the values; and the names that no field has."""
    doc = Document(data)
    by_name: dict[str, dict] = {}
    for f in doc.fields():
        by_name.setdefault(f["full_name"], f)
        by_name.setdefault(f["t"], f)
    changed: dict[int, object] = {}
    unknown = []
    for name, value in values.items():
        f = by_name.get(name)
        if not f or f["obj_num"] is None:
            unknown.append(name)
            continue
        d = dict(changed.get(f["obj_num"], doc.obj(f["obj_num"])))
        if f.get("FT") == "Btn":
            state = Name({True: "Yes", False: "Off"}.get(value, str(value)))
            d |= {"V": state, "AS": state}
        else:
            d["V"] = str(value)
            d.pop("AP", None)
        changed[f["obj_num"]] = d
    root = doc.trailer["Root"][0]
    form = (doc.get(doc.trailer["Root"]) or {}).get("AcroForm")
    if changed and form is not None:
        if isinstance(form, Ref):
            changed[form[0]] = doc.form() | {"NeedAppearances": True}
        else:
            changed[root] = doc.obj(root) | {"AcroForm": form | {"NeedAppearances": True}}
    return (append_revision(data, changed) if changed else data), unknown


def with_packets(data: bytes, packets: dict[str, bytes]) -> bytes:
    """The document with an appended revision in which these form packets are new or replaced, in place and order."""
    doc = Document(data)
    have = {p["name"]: p["obj_num"] for p in doc.xfa_packets()}
    body = lambda b: Stream({"Filter": Name("FlateDecode")}, zlib.compress(b))
    changed: dict[int, object] = {}
    top = max(doc.entries, default=0) + 1
    new = []
    for name, b in packets.items():
        if have.get(name) is not None:
            changed[have[name]] = body(b)
            continue
        changed[top] = body(b)
        new += [name, Ref(top)]
        top += 1
    if new:
        root = doc.trailer["Root"]
        form = (doc.get(root) or {}).get("AcroForm")
        old = doc.get(doc.form().get("XFA"))
        whole = dict(doc.form()) | {"XFA": [*(old if isinstance(old, list) else []), *new]}
        whole.setdefault("Fields", [])
        if isinstance(form, Ref):
            changed[form[0]] = whole
        else:
            changed[root[0]] = dict(doc.get(root)) | {"AcroForm": whole}
    return append_revision(data, changed) if changed else data


def update_packet_values(data: bytes, values: dict[str, object]) -> tuple[bytes, list[str]]:
    """The document with new values in its datasets packet; and the names that the packet doesn't have."""
    packet = next((p for p in Document(data).xfa_packets() if p["name"] == "datasets"), None)
    if packet is None or packet["obj_num"] is None:
        raise DocError("no_object", "no datasets packet")
    xml, unknown = xfa.update_values(packet["data"], values)
    return with_packets(data, {"datasets": xml.encode()}), unknown


def build_from_packets(packets: dict[str, bytes], pages: list[Page] | None = None) -> bytes:
    """A document of form packets: all of them, in the order given, on a blank page unless others are given."""
    return with_packets(build(pages or [Page()]), packets)


def flatten_form(data: bytes) -> bytes:
    """Field values as page content instead of fields."""
    doc = Document(data)
    values = {f["obj_num"]: f for f in doc.fields()}
    changed: dict[int, object] = {}
    top = max(doc.entries) + 1
    for num, attrs in doc.pages():
        kept, ops = [], []
        for ref in doc.get(attrs.get("Annots")) or []:
            d = doc.get(ref)
            if not isinstance(d, dict) or d.get("Subtype") != "Widget":
                kept.append(ref)
                continue
            v = values.get(ref[0] if isinstance(ref, Ref) else None, {}).get("V", d.get("V"))
            if isinstance(v, bytes) and d.get("Rect"):
                x, y = (float(doc.get(k)) for k in d["Rect"][:2])
                ops.append(b"BT /FlatHelv 10 Tf %s %s Td %s Tj ET" % (write_value(x + 2), write_value(y + 2), write_value(v)))
        page = dict(doc.obj(num)) | {"Annots": kept}
        if ops:
            changed[top] = Stream({}, b"q\n" + b"\n".join(ops) + b"\nQ")
            resources = dict(doc.get(attrs.get("Resources")) or {})
            resources["Font"] = dict(doc.get(resources.get("Font")) or {}) | {"FlatHelv": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}
            c = doc.get(page.get("Contents"))
            page |= {"Resources": resources, "Contents": [*(c if isinstance(c, list) else [page["Contents"]] if c is not None else []), Ref(top)]}
            top += 1
        changed[num] = page
    root = dict(doc.get(doc.trailer["Root"]))
    root.pop("AcroForm", None)
    changed[doc.trailer["Root"][0]] = root
    return append_revision(data, changed)


# -- builder


def jpeg_header(data: bytes) -> tuple[int, int, str]:
    """Width, height and colour space from the frame header."""
    if data[:2] != b"\xff\xd8":
        raise DocError("bad_image", "no JPEG")
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[data[at + 9]]
        at += 2 if 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise DocError("bad_image", "no frame")


#: First column and row, and steps, of the passes of an interlaced image.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _samples(raw: bytes, w: int, h: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples of filtered rows (of 16 bits the upper eight), and the bytes they took."""
    width = (channels * bits * w + 7) // 8
    if not w or not h:
        return np.zeros((h, w, channels), np.uint8), 0
    n = (width + 1) * h
    rows = np.frombuffer(unpredict(raw[:n], {"Predictor": 15, "Colors": channels, "BitsPerComponent": bits, "Columns": w}), np.uint8).reshape(h, width)
    if bits == 16:
        return rows.reshape(h, w, channels, 2)[..., 0], n
    if bits < 8:
        rows = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
    return rows[:, : w * channels].reshape(h, w, channels).astype(np.uint8), n


def png_image(data: bytes) -> tuple[dict, bytes, bytes | None]:
    """A PNG as image attributes, data, and compressed 8-bit alpha if it has any.

    Grey and RGB without alpha and interlace keep their own compression; all others are written anew with 8 bits.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise DocError("bad_image", "no PNG")
    w, h, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None:
        raise DocError("bad_image", f"colour type {kind}")
    parts, at = {b"IDAT": b"", b"PLTE": b"", b"tRNS": b""}, 8
    while at + 8 <= len(data):
        n, tag = struct.unpack(">I4s", data[at : at + 8])
        if tag in parts:
            parts[tag] += data[at + 8 : at + 8 + n]
        at += 12 + n
    attrs = lambda colors, b: {"Width": w, "Height": h, "BitsPerComponent": b, "ColorSpace": Name("DeviceGray" if colors == 1 else "DeviceRGB"), "Filter": Name("FlateDecode")}
    if kind in (0, 2) and not interlace:
        return attrs(channels, bits) | {"DecodeParms": {"Predictor": 15, "Colors": channels, "BitsPerComponent": bits, "Columns": w}}, parts[b"IDAT"], None
    raw, at = zlib.decompress(parts[b"IDAT"]), 0
    pixels = np.zeros((h, w, channels), np.uint8)
    for x, y, dx, dy in PASSES if interlace else [(0, 0, 1, 1)]:
        some, n = _samples(raw[at:], max(0, -(-(w - x) // dx)), max(0, -(-(h - y) // dy)), bits, channels)
        pixels[y::dy, x::dx] = some
        at += n
    alpha = None
    if kind == 3:
        table = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        if parts[b"tRNS"]:
            alpha = np.concatenate((np.frombuffer(parts[b"tRNS"], np.uint8), np.full(256, 255, np.uint8)))[pixels[..., 0]]
        pixels = table[pixels[..., 0]]
    elif kind in (4, 6):
        pixels, alpha = pixels[..., :-1], pixels[..., -1]
    elif bits < 8:
        pixels = (pixels.astype(np.uint16) * 255 // (2**bits - 1)).astype(np.uint8)
    return attrs(pixels.shape[2], 8), zlib.compress(pixels.tobytes()), None if alpha is None else zlib.compress(np.ascontiguousarray(alpha).tobytes())


class Page:
    """Content operators of a page, each returning the page."""

    def __init__(self, width: float = 612, height: float = 792):
        self.size, self.ops, self.fonts, self.images, self.states = (width, height), [], {}, {}, {}

    def op(self, *parts) -> Page:
        self.ops.append(b" ".join(p if isinstance(p, bytes) else write_value(p) for p in parts))
        return self

    def text(self, s: str, x: float, y: float, size: float = 12, font: str = "Helvetica") -> Page:
        key = self.fonts.setdefault(font, f"F{len(self.fonts) + 1}")
        return self.op(b"BT", Name(key), float(size), b"Tf", float(x), float(y), b"Td", write_value(s.encode("cp1252", "replace")), b"Tj", b"ET")

    def rect(self, x: float, y: float, w: float, h: float, fill: bool = False) -> Page:
        return self.op(float(x), float(y), float(w), float(h), b"re", b"f" if fill else b"S")

    def line(self, x1: float, y1: float, x2: float, y2: float, width: float = 1) -> Page:
        return self.op(float(width), b"w").op(float(x1), float(y1), b"m").op(float(x2), float(y2), b"l", b"S")

    def color(self, *rgb: float, stroke: bool = False) -> Page:
        return self.op(*map(float, rgb), {1: b"g", 3: b"rg", 4: b"k"}[len(rgb)].upper() if stroke else {1: b"g", 3: b"rg", 4: b"k"}[len(rgb)])

    def transform(self, *m: float) -> Page:
        return self.op(*map(float, m), b"cm")

    def save(self) -> Page:
        return self.op(b"q")

    def restore(self) -> Page:
        return self.op(b"Q")

    def image(self, data: bytes, x: float, y: float, w: float, h: float) -> Page:
        key = self.images.setdefault(data, f"Im{len(self.images) + 1}")
        return self.save().transform(w, 0, 0, h, x, y).op(Name(key), b"Do").restore()

    def opacity(self, share: float) -> Page:
        """How much of what follows covers what is there, until the state is restored."""
        return self.op(Name(self.states.setdefault(float(share), f"GS{len(self.states) + 1}")), b"gs")

    def watermark(self, s: str, size: float = 48, angle: float = 45, grey: float = 0.8, opacity: float = 1.0) -> Page:
        c, n = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        page = self.save().color(grey)
        if opacity < 1:
            page.opacity(opacity)
        return page.transform(c, n, -n, c, self.size[0] / 4, self.size[1] / 4).text(s, 0, 0, size).restore()

    def image_watermark(self, data: bytes, w: float, h: float, opacity: float = 0.3) -> Page:
        """An image over the middle of the page."""
        return self.save().opacity(opacity).image(data, (self.size[0] - w) / 2, (self.size[1] - h) / 2, w, h).restore()


def build(pages: list[Page], metadata: dict[str, str] | None = None, bookmarks: list[dict] | None = None, fields: list[dict] | None = None, links: list[dict] | None = None, **how) -> bytes:
    """Pages with optional metadata, outline ({title, page, children}), text fields ({name, page, rect, value, ...}) and links ({uri, page, rect})."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Count": len(pages)}}
    add = lambda v: objects.update({len(objects) + 1: v}) or len(objects)
    fonts: dict[str, int] = {}
    kids = []
    for p in pages:
        for f in p.fonts:
            if f not in fonts:
                fonts[f] = add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f), "Encoding": Name("WinAnsiEncoding")})
        shown = {}
        for data, key in p.images.items():
            if data[:2] == b"\xff\xd8":
                w, h, cs = jpeg_header(data)
                attrs, body = {"Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(cs), "Filter": Name("DCTDecode")}, data
            else:
                attrs, body, alpha = png_image(data)
                if alpha is not None:
                    mask = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": attrs["Width"], "Height": attrs["Height"], "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), "Filter": Name("FlateDecode")}
                    attrs |= {"SMask": Ref(add(Stream(mask, alpha)))}
            shown[key] = Ref(add(Stream(attrs | {"Type": Name("XObject"), "Subtype": Name("Image")}, body)))
        content = add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(p.ops))))
        kids.append(add({"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, *p.size], "Contents": Ref(content), "Resources": {"Font": {k: Ref(fonts[f]) for f, k in p.fonts.items()}, "XObject": shown} | ({"ExtGState": {k: {"Type": Name("ExtGState"), "ca": v, "CA": v} for v, k in p.states.items()}} if p.states else {})}))
    objects[2]["Kids"] = [Ref(k) for k in kids]
    if fields:
        refs = []
        for f in fields:
            n = add({"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name(f.get("type", "Tx")), "T": f["name"], "Rect": list(f["rect"]), "P": Ref(kids[f.get("page", 1) - 1])} | ({"V": f["value"]} if f.get("value") is not None else {}) | ({"Ff": f["flags"]} if "flags" in f else {}) | ({"MaxLen": f["max_len"]} if "max_len" in f else {}) | ({"Opt": list(f["options"])} if "options" in f else {}))
            objects[kids[f.get("page", 1) - 1]].setdefault("Annots", []).append(Ref(n))
            refs.append(Ref(n))
        objects[1]["AcroForm"] = Ref(add({"Fields": refs, "DA": "/Helv 12 Tf 0 g"}))

    for k in links or ():
        n = add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": list(k["rect"]), "A": {"S": Name("URI"), "URI": k["uri"]}})
        objects[kids[k.get("page", 1) - 1]].setdefault("Annots", []).append(Ref(n))

    def outline(items: list[dict], parent: int) -> tuple[int, int]:
        nums = [add({}) for _ in items]
        for i, (n, b) in enumerate(zip(nums, items, strict=True)):
            d = {"Title": b["title"], "Parent": Ref(parent), "Dest": [Ref(kids[b["page"] - 1]), Name("Fit")]}
            d |= ({"Prev": Ref(nums[i - 1])} if i else {}) | ({"Next": Ref(nums[i + 1])} if i + 1 < len(nums) else {})
            if b.get("children"):
                first, last = outline(b["children"], n)
                d |= {"First": Ref(first), "Last": Ref(last), "Count": len(b["children"])}
            objects[n] = d
        return nums[0], nums[-1]

    if bookmarks:
        top = add({})
        first, last = outline(bookmarks, top)
        objects[top] = {"Type": Name("Outlines"), "First": Ref(first), "Last": Ref(last), "Count": len(bookmarks)}
        objects[1]["Outlines"] = Ref(top)
    trailer = {"Root": Ref(1)}
    if metadata:
        names = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "modified_date": "ModDate"}
        trailer["Info"] = Ref(add({names.get(re.sub(r"[ -]", "_", k.lower()), k): v for k, v in metadata.items()}))
    return write(objects, trailer, **how)


def encrypt(data: bytes, user: bytes, owner: bytes = b"", method: str = "AESV3", permissions: int = -4, random=None) -> bytes:
    """The same objects, encrypted; ``random`` gives salts, keys and vectors (the system's by default)."""
    import os

    doc = Document(data)
    objects = {n: v for n, e in doc.entries.items() if e[0] != "free" and (v := doc.obj(n)) is not None and not (isinstance(v, Stream) and v.attrs.get("Type") in ("XRef", "ObjStm"))}
    file_id = doc.file_id() or hashlib.md5(data).digest()
    secret = crypto.setup(user, owner, file_id, permissions, method, random=random or os.urandom)
    trailer = {k: doc.trailer[k] for k in ("Root", "Info") if k in doc.trailer} | {"ID": [file_id, file_id]}
    return write(objects, trailer, encryption=secret, random=random)


def decrypt(data: bytes, password: bytes) -> bytes:
    """The same objects without encryption."""
    doc = Document(data, password)
    lock = doc.trailer.get("Encrypt")
    skip = lock[0] if isinstance(lock, Ref) else -1
    objects = {n: v for n, e in doc.entries.items() if n != skip and e[0] != "free" and (v := doc.obj(n)) is not None and not (isinstance(v, Stream) and v.attrs.get("Type") in ("XRef", "ObjStm"))}
    return write(objects, {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer})
