"""Content streams: an ordered fold of operators into text, graphics and image placements."""

from __future__ import annotations

import re
import unicodedata

from docloom.pdf.document import Document
from docloom.pdf.syntax import Keyword, Name, DocError, Reader, Ref, Stream, text_of

#: Glyph names of punctuation, as the standard encodings spell them.
GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›", "guillemotleft": "«", "guillemotright": "»", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "fi": "ﬁ", "fl": "ﬂ", "Euro": "€", "cent": "¢", "sterling": "£", "yen": "¥", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "periodcentered": "·", "exclamdown": "¡", "questiondown": "¿", "nbspace": " "}
ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK"}
STANDARD_14 = {"Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Symbol", "ZapfDingbats"}


def glyph_char(name: str) -> str:
    """A glyph name as text: letters, listed names, accented letters by rule, uniXXXX and uXXXX."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace") if m[1] else chr(int(m[2], 16))
    if m := re.fullmatch(r"([A-Za-z])(" + "|".join(ACCENTS) + ")", name):
        try:
            return unicodedata.lookup(f"LATIN {'SMALL' if m[1].islower() else 'CAPITAL'} LETTER {m[1].upper()} WITH {ACCENTS[m[2]]}")
        except KeyError:
            return m[1]
    return glyph_char(name.split(".")[0]) if "." in name[1:] else ""


def parse_cmap(data: bytes) -> tuple[dict[int, str], int]:
    """Codes to text, and bytes of a code, from a to-Unicode map."""
    out: dict[int, str] = {}
    width, r, stack = 1, Reader(data), []
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    while True:
        try:
            v = r.value(refs=False)
        except DocError:
            return out, width
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        if v == b"endcodespacerange" and stack and isinstance(stack[-1], bytes):
            width = max(1, len(stack[-1]))
        elif v == b"endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[int.from_bytes(a, "big")] = text(b)
        elif v == b"endbfrange":
            for a, z, b in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(z, "big")
                for k in range(lo, min(hi, lo + 65535) + 1):
                    if isinstance(b, list):
                        if k - lo < len(b):
                            out[k] = text(b[k - lo])
                    else:
                        out[k] = text((int.from_bytes(b, "big") + k - lo).to_bytes(len(b), "big"))
        stack = []


class Font:
    """Decodes codes in the order: to-Unicode map, differences, base encoding."""

    def __init__(self, doc: Document, attrs: dict):
        get = doc.get
        self.subtype, self.base = str(attrs.get("Subtype", "")), str(attrs.get("BaseFont", ""))
        self.family = self.base.split("+")[-1].split("-")[0]
        encoding = get(attrs.get("Encoding"))
        self.encoding = str(encoding.get("BaseEncoding", "")) if isinstance(encoding, dict) else str(encoding or "")
        self.codec = {"MacRomanEncoding": "mac_roman"}.get(self.encoding, "cp1252")
        self.to_unicode, self.width, self.differences = {}, 2 if self.subtype == "Type0" else 1, {}
        s = get(attrs.get("ToUnicode"))
        self.has_map = isinstance(s, Stream)
        if self.has_map:
            self.to_unicode, width = parse_cmap(doc.decode(s))
            self.width = 2 if self.subtype == "Type0" else width
        code = 0
        for x in (get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(x, Name):
                self.differences[code] = glyph_char(x)
                code += 1
            elif isinstance(x, int):
                code = x
        d = get(attrs.get("FontDescriptor"))
        if self.subtype == "Type0":
            d = get((get((get(attrs.get("DescendantFonts")) or [{}])[0]) or {}).get("FontDescriptor"))
        self.embedded = isinstance(d, dict) and any(k in d for k in ("FontFile", "FontFile2", "FontFile3"))
        widths = get(attrs.get("Widths")) or []
        self.first, self.widths = attrs.get("FirstChar", 0), [float(get(w) or 0) for w in widths]
        self.known: dict[int, tuple[str, float]] = {}

    def codes(self, b: bytes) -> list[int] | bytes:
        return b if self.width == 1 else [int.from_bytes(b[i : i + self.width], "big") for i in range(0, len(b), self.width)]

    def _look(self, c: int) -> tuple[str, float]:
        """Text of a code, and its width in text units of one; 0.6 for codes without one."""
        t = self.to_unicode.get(c) or self.differences.get(c)
        t = t if t is not None else bytes([c]).decode(self.codec, "replace") if c < 256 else "�"
        self.known[c] = t, self.widths[c - self.first] / 1000 if 0 <= c - self.first < len(self.widths) else 0.6
        return self.known[c]

    def decode(self, b: bytes) -> str:
        if self.width == 1 and not self.to_unicode and not self.differences:
            return b.decode(self.codec, "replace")
        return "".join([(self.known.get(c) or self._look(c))[0] for c in self.codes(b)])

    def advance(self, b: bytes) -> float:
        if not self.widths:
            return sum([0.6] * (-(-len(b) // self.width)))
        return sum([(self.known.get(c) or self._look(c))[1] for c in self.codes(b)])


def times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


_PAINT = {b"S": "stroke", b"s": "stroke", b"f": "fill", b"F": "fill", b"f*": "fill", b"B": "fill_stroke", b"B*": "fill_stroke", b"b": "fill_stroke", b"b*": "fill_stroke", b"n": "none"}


def interpret(doc: Document, data: bytes, resources: dict, depth: int = 0, matrix: list[float] | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """Text elements, graphics and image placements of a content stream; forms are entered."""
    get = doc.get
    fonts: dict[str, Font] = {}
    named = {k: get(v) for k, v in (get(resources.get("Font")) or {}).items()}
    objects = get(resources.get("XObject")) or {}
    texts, graphics, images = [], [], []
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    s = {"ctm": matrix or one, "font": "", "size": 0.0, "char": 0.0, "word": 0.0, "rise": 0.0, "scale": 1.0, "lead": 0.0, "fill": [0.0], "stroke": [0.0], "line": 1.0}
    saved, path, start = [], [], (0.0, 0.0)
    tm = line = one
    r, stack = Reader(data), []

    def font() -> Font | None:
        if s["font"] not in fonts and isinstance(named.get(s["font"]), dict):
            fonts[s["font"]] = Font(doc, named[s["font"]])
        return fonts.get(s["font"])

    def show(parts: list) -> None:
        nonlocal tm
        f, begin, out, width = font(), times([1, 0, 0, 1, 0, s["rise"]], times(tm, s["ctm"])), [], 0.0
        for p in parts:
            if isinstance(p, bytes):
                out.append(f.decode(p) if f else p.decode("latin-1"))
                n = len(p) // (f.width if f else 1)
                width += ((f.advance(p) if f else 0.6 * n) * s["size"] + n * s["char"] + p.count(b" ") * s["word"]) * s["scale"]
            elif isinstance(p, (int, float)):
                width -= p / 1000 * s["size"] * s["scale"]
        if out:
            texts.append({"text": "".join(out), "x": begin[4], "y": begin[5], "width": width, "height": s["size"], "font_name": s["font"], "font_size": s["size"], "char_spacing": s["char"], "word_spacing": s["word"], "rise": s["rise"], "text_matrix": begin})
        tm = times([1, 0, 0, 1, width, 0], tm)

    def at(x: float, y: float) -> tuple[float, float]:
        m = s["ctm"]
        return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]

    while True:
        try:
            v = r.value(refs=False)
        except DocError:
            break
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        a, stack = stack, []
        n = [float(x) for x in a if isinstance(x, (int, float)) and not isinstance(x, bool)]
        try:
            if v == b"q":
                saved.append(dict(s))
            elif v == b"Q" and saved:
                s = saved.pop()
            elif v == b"cm":
                s["ctm"] = times(n, s["ctm"])
            elif v == b"BT":
                tm = line = one
            elif v == b"Tf":
                s["font"], s["size"] = str(a[0]), n[0]
            elif v in (b"Tc", b"Tw", b"Ts", b"TL"):
                s[{b"Tc": "char", b"Tw": "word", b"Ts": "rise", b"TL": "lead"}[bytes(v)]] = n[0]
            elif v == b"Tz":
                s["scale"] = n[0] / 100
            elif v in (b"Td", b"TD"):
                s["lead"] = -n[1] if v == b"TD" else s["lead"]
                tm = line = times([1, 0, 0, 1, n[0], n[1]], line)
            elif v == b"Tm":
                tm = line = n[:6]
            elif v in (b"T*", b"'", b'"'):
                if v == b'"':
                    s["word"], s["char"] = n[0], n[1]
                tm = line = times([1, 0, 0, 1, 0, -s["lead"]], line)
                if v != b"T*":
                    show([a[-1]])
            elif v == b"Tj":
                show(a[-1:])
            elif v == b"TJ":
                show(a[-1])
            elif v in (b"m", b"l"):
                path.append(("move" if v == b"m" else "line", [at(*n[:2])]))
                start = n[:2] if v == b"m" else start
            elif v in (b"c", b"v", b"y"):
                path.append(("curve", [at(*n[i : i + 2]) for i in range(0, len(n) - 1, 2)]))
            elif v == b"h":
                path.append(("close", [at(*start)]))
            elif v == b"re":
                x, y, w, h = n[:4]
                path.append(("rect", [at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)]))
            elif bytes(v) in _PAINT:
                if path and v != b"n":
                    xs, ys = [p[0] for _, ps in path for p in ps], [p[1] for _, ps in path for p in ps]
                    kind = "rectangle" if len(path) == 1 and path[0][0] == "rect" else "line" if [o for o, _ in path] == ["move", "line"] else "path"
                    graphics.append({"type": kind, "paint": _PAINT[bytes(v)], "ops": [{"op": o, "points": [list(p) for p in ps]} for o, ps in path], "bbox": [min(xs), min(ys), max(xs), max(ys)], "fill": s["fill"], "stroke": s["stroke"], "line_width": s["line"]})
                path = []
            elif v == b"w":
                s["line"] = n[0]
            elif v in (b"rg", b"g", b"k", b"sc", b"scn"):
                s["fill"] = n
            elif v in (b"RG", b"G", b"K", b"SC", b"SCN"):
                s["stroke"] = n
            elif v == b"Do":
                x = get(objects.get(a[-1]))
                if isinstance(x, Stream) and x.attrs.get("Subtype") == "Image":
                    m = s["ctm"]
                    ref = objects.get(a[-1])
                    images.append({"image_id": str(a[-1]), "obj_num": ref[0] if isinstance(ref, Ref) else None, "x": m[4], "y": m[5], "width": (m[0] ** 2 + m[1] ** 2) ** 0.5, "height": (m[2] ** 2 + m[3] ** 2) ** 0.5})
                elif isinstance(x, Stream) and depth < 12:
                    m = [float(get(k)) for k in get(x.attrs.get("Matrix")) or one]
                    inner = interpret(doc, doc.decode(x), get(x.attrs.get("Resources")) or resources, depth + 1, times(m, s["ctm"]))
                    for have, got in zip((texts, graphics, images), inner, strict=True):
                        have += got
            elif v == b"BI":
                end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(data, r.at)
                r.at = end.end() if end else len(data)
        except (IndexError, ValueError, TypeError, KeyError):
            doc.warnings.append(("content", f"operator {bytes(v)[:8]!r} without its operands"))
    return texts, graphics, images


def page_content(doc: Document, attrs: dict) -> bytes:
    c = doc.get(attrs.get("Contents"))
    parts = [doc.get(x) for x in c] if isinstance(c, list) else [c]
    return b"\n".join(doc.decode(p) for p in parts if isinstance(p, Stream))


def appearances(doc: Document) -> list[dict]:
    """Normal appearances of form widgets, one for each state (null: the only one)."""
    out = []
    for f in doc.fields():
        d = doc.obj(f["obj_num"]) if f["obj_num"] is not None else None
        normal = doc.get((doc.get(d.get("AP")) or {}).get("N")) if isinstance(d, dict) else None
        states = {None: normal} if isinstance(normal, Stream) else {str(k): doc.get(v) for k, v in normal.items()} if isinstance(normal, dict) else {}
        out += [{"obj_num": f["obj_num"], "full_name": f["full_name"], "state": k, "bbox": [float(doc.get(x)) for x in doc.get(v.attrs.get("BBox")) or []], "data": doc.decode(v)} for k, v in states.items() if isinstance(v, Stream)]
    return out


def extract(data: bytes, password: bytes = b"") -> dict:
    """Everything a document shows, as lists of rows by kind."""
    doc = Document(data, password)
    get = doc.get
    out: dict = {"metadata": doc.metadata(), "pages": [], "text_elements": [], "graphics": [], "image_refs": [], "images": [], "fonts": [], "annotations": doc.annotations(), "bookmarks": doc.outline()}
    seen_fonts, seen_images = set(), set()
    for n, (num, attrs) in enumerate(doc.pages(), 1):
        box = [float(get(x) or 0) for x in get(attrs.get("MediaBox")) or [0, 0, 612, 792]]
        resources = get(attrs.get("Resources")) or {}
        texts, graphics, images = interpret(doc, page_content(doc, attrs), resources)
        out["pages"].append({"page": n, "obj_num": num, "width": box[2] - box[0], "height": box[3] - box[1], "rotation": int(get(attrs.get("Rotate")) or 0) % 360, "boxes": {k: [float(get(x) or 0) for x in get(attrs[k])] for k in ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox") if get(attrs.get(k))}})
        for kind, rows in (("text_elements", texts), ("graphics", graphics), ("image_refs", images)):
            out[kind] += [{"page": n, "idx": i} | r for i, r in enumerate(rows)]
        for k, ref in sorted((get(resources.get("Font")) or {}).items()):
            if k not in seen_fonts and isinstance(get(ref), dict):
                seen_fonts.add(k)
                f = Font(doc, get(ref))
                out["fonts"].append({"font_id": k, "name": f.base, "family": f.family, "subtype": f.subtype, "embedded": f.embedded, "standard": f.base in STANDARD_14, "encoding": f.encoding, "has_to_unicode": f.has_map})
        for k, ref in sorted((get(resources.get("XObject")) or {}).items()):
            x = get(ref)
            if k not in seen_images and isinstance(x, Stream) and x.attrs.get("Subtype") == "Image":
                seen_images.add(k)
                f = get(x.attrs.get("Filter"))
                f = str(f[-1] if isinstance(f, list) else f or "")
                cs = get(x.attrs.get("ColorSpace"))
                out["images"].append({"image_id": k, "obj_num": ref[0] if isinstance(ref, Ref) else None, "width": get(x.attrs.get("Width")), "height": get(x.attrs.get("Height")), "bits": get(x.attrs.get("BitsPerComponent")), "color_space": str(cs[0] if isinstance(cs, list) else cs or ""), "format": {"DCTDecode": "jpeg", "JPXDecode": "jp2", "CCITTFaxDecode": "tiff", "JBIG2Decode": "jbig2"}.get(f, "raw"), "data": doc.decode(x)})
    out["fields"] = doc.fields()
    out["xfa"] = doc.xfa_packets()
    out["appearances"] = appearances(doc)
    out["warnings"] = [{"code": c, "message": m} for c, m in doc.warnings]
    out["text"] = "\n".join(" ".join(t["text"] for t in out["text_elements"] if t["page"] == p["page"]) for p in out["pages"])
    return out


__all__ = ["extract", "interpret", "page_content", "Font", "glyph_char", "parse_cmap", "text_of"]
