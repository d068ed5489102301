"""Authoring: content operators as a fluent list or as rows, field definitions, actions, appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.pdf.syntax import DocError, Keyword, Name, Ref, Stream, write_value

#: Operators by what they do: the sign, and how many numbers it takes (None: other operands).
OPERATORS = {
    "save_state": ("q", 0), "restore_state": ("Q", 0), "set_matrix": ("cm", 6), "fill_rgb": ("rg", 3), "stroke_rgb": ("RG", 3), "fill_gray": ("g", 1), "stroke_gray": ("G", 1),
    "fill_cmyk": ("k", 4), "stroke_cmyk": ("K", 4), "move_to": ("m", 2), "line_to": ("l", 2), "curve_to": ("c", 6), "curve_to_v": ("v", 4), "curve_to_y": ("y", 4), "rectangle": ("re", 4),
    "close_path": ("h", 0), "stroke": ("S", 0), "close_stroke": ("s", 0), "fill": ("f", 0), "fill_even_odd": ("f*", 0), "fill_stroke": ("B", 0), "clip": ("W", 0), "end_path": ("n", 0),
    "line_width": ("w", 1), "line_cap": ("J", 1), "line_join": ("j", 1), "miter_limit": ("M", 1), "line_dash": ("d", None), "begin_text": ("BT", 0), "end_text": ("ET", 0),
    "set_font": ("Tf", None), "text_position": ("Td", 2), "text_position_leading": ("TD", 2), "text_matrix": ("Tm", 6), "show_text": ("Tj", None), "show_next_line": ("'", None),
    "show_array": ("TJ", None), "render_mode": ("Tr", 1), "text_leading": ("TL", 1), "next_line": ("T*", 0), "char_spacing": ("Tc", 1), "word_spacing": ("Tw", 1), "text_rise": ("Ts", 1),
    "text_scale": ("Tz", 1), "draw": ("Do", None),
}


class Content:
    """``Content().begin_text().set_font(Name("F1"), 12)...``: each call appends one operator."""

    def __init__(self):
        self.ops: list[tuple[str, list]] = []

    def __getattr__(self, name: str):
        if name not in OPERATORS:
            raise AttributeError(name)
        sign, count = OPERATORS[name]

        def call(*args):
            if count is not None and len(args) != count:
                raise DocError("content", f"{name} takes {count} numbers")
            self.ops.append((sign, list(args)))
            return self

        return call

    def translate(self, x: float, y: float) -> Content:
        return self.set_matrix(1, 0, 0, 1, x, y)

    def scale(self, x: float, y: float) -> Content:
        return self.set_matrix(x, 0, 0, y, 0, 0)

    def draw_at(self, name: str, x: float, y: float, w: float, h: float) -> Content:
        return self.save_state().set_matrix(w, 0, 0, h, x, y).draw(Name(name)).restore_state()

    def raw(self, data: bytes) -> Content:
        self.ops.append(("", [Keyword(data)]))
        return self

    def bytes(self) -> bytes:
        return b"\n".join(b" ".join([*map(write_value, a), *([s.encode()] if s else [])]) for s, a in self.ops)


def content_from_rows(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Content streams of rows ``keys, seq, op, args array<string>`` (operands already written)."""
    rows = ops.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "args", "op"))).alias("o"))
    return rows.select(*keys, F.encode(F.array_join(F.transform("o", lambda x: F.concat_ws(" ", x["args"], x["op"])), "\n"), "UTF-8").alias("content"))


def action(kind: str, target: object = None) -> dict:
    """An action of a field or annotation."""
    make = {
        "URI": lambda: {"URI": str(target).encode()}, "JavaScript": lambda: {"JS": str(target)}, "ResetForm": lambda: {},
        "SubmitForm": lambda: {"F": {"FS": Name("URL"), "F": str(target).encode()}}, "GoTo": lambda: {"D": [target, Name("Fit")]}, "Named": lambda: {"N": Name(str(target))},
    }
    if kind not in make:
        raise DocError("action", kind)
    return {"S": Name(kind)} | make[kind]()


def with_mouse_action(field: dict, event: str, act: dict) -> dict:
    """The field with an action for an event: enter, exit, down, up, focus or blur."""
    sign = {"enter": "E", "exit": "X", "down": "D", "up": "U", "focus": "Fo", "blur": "Bl"}[event]
    return field | {"AA": dict(field.get("AA") or {}) | {sign: act}}


def _form(width: float, height: float, c: Content, resources: dict | None = None) -> Stream:
    return Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, width, height], "Resources": resources or {}}, c.bytes())


_HELV = {"Font": {"Helv": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}}


def checkbox_appearance(checked: bool, width: float, height: float) -> Stream:
    c = Content().save_state().rectangle(0.5, 0.5, width - 1, height - 1).stroke()
    if checked:
        c.line_width(2).move_to(width * 0.2, height * 0.5).line_to(width * 0.4, height * 0.2).line_to(width * 0.8, height * 0.8).stroke()
    return _form(width, height, c.restore_state())


def text_appearance(text: str, width: float, height: float, size: float = 12) -> Stream:
    c = Content().save_state().begin_text().set_font(Name("Helv"), size).text_position(2, (height - size) / 2 + 2).show_text(text.encode("cp1252", "replace")).end_text().restore_state()
    return _form(width, height, c, _HELV)


def button_appearance(label: str, width: float, height: float, size: float = 12) -> Stream:
    c = Content().save_state().fill_gray(0.85).rectangle(0, 0, width, height).fill().fill_gray(0).begin_text().set_font(Name("Helv"), size)
    return _form(width, height, c.text_position(4, (height - size) / 2 + 2).show_text(label.encode("cp1252", "replace")).end_text().restore_state(), _HELV)


def with_appearance(field: dict, normal: Ref | dict[str, Ref]) -> dict:
    """The field with its normal appearance: one form, or a form for each state."""
    return field | {"AP": {"N": normal}}


#: Flags by kind of field.
FIELD_KINDS = {"text": ("Tx", 0), "checkbox": ("Btn", 0), "radio": ("Btn", 0x8000), "button": ("Btn", 0x10000), "choice": ("Ch", 0x20000), "list": ("Ch", 0), "signature": ("Sig", 0)}


def field(kind: str, name: str, rect: list[float], page: int = 1, required: bool = False, read_only: bool = False, **more) -> dict:
    """A definition for ``writer.build(fields=[...])``."""
    ft, flags = FIELD_KINDS[kind]
    return {"type": ft, "name": name, "rect": rect, "page": page, "flags": flags | 2 * required | read_only} | more
