"""Form packets in XML: template, datasets, config, locales, connections, styles; reading and updating."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from docloom.functions.text import RESPONSE_TYPES


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _child(e: ET.Element, *names: str) -> ET.Element | None:
    return next((c for c in e if _tag(c) in names), None)


def _deep(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _all(root: ET.Element, name: str):
    return (e for e in root.iter() if _tag(e) == name)


def parse(xml: str | bytes) -> ET.Element:
    return ET.fromstring(xml)


def typed(value: str) -> tuple[str, object]:
    """bool before int before float before string."""
    v = value.strip()
    if not v:
        return "empty", ""
    if v.lower() in ("true", "1", "false", "0"):
        return "bool", v.lower() in ("true", "1")
    for kind, f in (("int", int), ("float", float)):
        try:
            return kind, f(v)
        except ValueError:
            continue
    return "string", value


def _truthy(s: str | None) -> bool:
    return (s or "").strip().lower() in ("1", "true", "yes", "required")


def field_id(name: str, index: int | None = None) -> str:
    kept = "".join("_" if c in " -" else c for c in name if c.isascii() and (c.isalnum() or c in "_ -"))
    if not kept:
        return "field" if index is None else f"field_{index}"
    return f"field_{kept}" if kept[0].isdigit() else kept


def template_questions(xml: str | bytes) -> list[dict]:
    """Fields of a template as questions, in order."""
    types = {k.lower(): v for k, v in RESPONSE_TYPES.items()}
    out = []
    for i, f in enumerate(e for e in parse(xml).iter() if _tag(e) in ("field", "exclGroup")):
        ui = _child(f, "ui")
        kind = f.get("type") or (_tag(ui[0]) if ui is not None and len(ui) else "exclGroup" if _tag(f) == "exclGroup" else "text")
        caption, label = _child(f, "caption"), _child(f, "label")
        rules = _child(f, "validate")
        out.append({
            "id": field_id(f.get("name", ""), i), "name": f.get("name", ""), "label": _deep(label if label is not None else caption) or f.get("name", ""),
            "type": types.get(kind.lower(), "text"), "required": _truthy(f.get("required")) or rules is not None and rules.get("nullTest") == "error",
            "readonly": f.get("access") in ("readOnly", "protected"), "hidden": f.get("presence") in ("hidden", "invisible"), "default": _deep(_child(f, "value")),
            "options": [_deep(t) for items in f if _tag(items) == "items" for t in items], "min_length": _int(f.get("minLength")), "max_length": _int(f.get("maxLength") or f.get("maxChars")),
            "pattern": _deep(_child(rules, "picture")) if rules is not None else "", "script": _deep(_child(rules, "script")) if rules is not None else "",
        })
    return out


def _int(s: str | None) -> int | None:
    return int(s) if s and s.strip().isdigit() else None


def template_rules(xml: str | bytes) -> list[dict]:
    """Calculations, validations and event scripts of a template's fields."""
    out = []
    for f in _all(parse(xml), "field"):
        for c in f:
            if _tag(c) in ("calculate", "validate", "event"):
                out.append({"field": f.get("name", ""), "kind": _tag(c), "activity": c.get("activity", ""), "script": _deep(_child(c, "script"))})
    return out


def page_count(xml: str) -> int:
    return max(1, xml.count("<pageSet"))


def dataset_values(xml: str | bytes) -> list[dict]:
    """Leaf values of the data part: by field elements with a name, or by plain element names."""
    root = parse(xml)
    data = next(_all(root, "data"), root)
    out = []

    def walk(e: ET.Element, path: tuple[str, ...]) -> None:
        for c in e:
            name = c.get("name") if _tag(c) == "field" and c.get("name") else _tag(c)
            value = _child(c, "value")
            if value is not None or not len(c):
                text = _deep(value) if value is not None else (c.text or "").strip()
                kind, _ = typed(text)
                out.append({"name": name, "path": ".".join([*path, name]), "value": text, "kind": kind})
            else:
                walk(c, (*path, name))

    walk(data, ())
    return out


def update_values(xml: str, values: dict[str, object]) -> tuple[str, list[str]]:
    """The packet with new values (escaped as XML needs), and the names it doesn't have."""
    root = parse(xml)
    data = next(_all(root, "data"), root)
    unknown = []
    for name, value in values.items():
        text = ("true" if value else "false") if isinstance(value, bool) else "" if value is None else str(value)
        e = next((e for e in data.iter() if e is not data and (e.get("name") == name or not e.get("name") and _tag(e) == name)), None)
        if e is None:
            unknown.append(name)
            continue
        v = _child(e, "value")
        if v is None and e.get("name"):
            v = ET.SubElement(e, "value")
        target = v if v is not None else e
        for c in list(target):
            target.remove(c)
        target.text = text
    return ET.tostring(root, encoding="unicode"), unknown


def attributes(xml: str | bytes) -> list[dict]:
    """Config, connection, locale and style packets as (path, attribute, value) rows; texts have no attribute."""
    out = []

    def walk(e: ET.Element, path: str) -> None:
        for k, v in e.attrib.items():
            out.append({"path": path, "attribute": k.rsplit("}", 1)[-1], "value": v})
        if (e.text or "").strip():
            out.append({"path": path, "attribute": None, "value": e.text.strip()})
        seen: dict[str, int] = {}
        for c in e:
            seen[_tag(c)] = seen.get(_tag(c), 0) + 1
            walk(c, f"{path}/{_tag(c)}[{seen[_tag(c)]}]")

    root = parse(xml)
    walk(root, _tag(root))
    return out


def locales(xml: str | bytes) -> dict:
    root = parse(xml)
    return {"default": root.get("default", ""), "locales": [{"code": e.get("code") or e.get("name", ""), "name": e.get("name") or e.get("desc", ""), "settings": {_tag(c): _deep(c) for c in e}} for e in _all(root, "locale")]}


def locale_rows(xml: str | bytes) -> list[dict]:
    found = locales(xml)
    return [r | {"is_default": r["code"] == found["default"]} for r in found["locales"]]


def connections(xml: str | bytes) -> list[dict]:
    """Connections with their address; other children are properties. Nothing is opened."""
    return [
        {"name": e.get("name", ""), "type": e.get("type") or _tag(e), "uri": _deep(_child(e, "uri", "wsdlAddress")), "properties": {_tag(c): _deep(c) for c in e if _tag(c) not in ("uri", "wsdlAddress")}}
        for e in parse(xml).iter()
        if _tag(e) == "connection" or _tag(e).endswith("Connection")
    ]


def styles(xml: str | bytes) -> list[dict]:
    return [{"name": e.get("name", ""), "type": e.get("type", ""), "properties": {f"{_tag(c)}.{k}": v for c in e for k, v in c.attrib.items()}} for e in _all(parse(xml), "style")]


def questions_xml(questions: list[dict]) -> str:
    """A template packet of questions: inverse of ``template_questions`` over what it keeps."""
    root = ET.Element("template")
    for q in questions:
        f = ET.SubElement(root, "field", name=q["name"], type="choiceList" if q.get("type") == "select" else q.get("type", "text"))
        if q.get("required"):
            f.set("required", "1")
        ET.SubElement(f, "label").text = q.get("label") or q["name"]
        if q.get("default"):
            ET.SubElement(f, "value").text = str(q["default"])
        if q.get("options"):
            items = ET.SubElement(f, "items")
            for o in q["options"]:
                ET.SubElement(items, "text").text = o
    return ET.tostring(root, encoding="unicode")


def rules_xml(rules: list[dict]) -> str:
    """A template packet of rules, each inside its field, so that reading gives them back."""
    root = ET.Element("template")
    fields: dict[str, ET.Element] = {}
    for r in rules:
        if r["field"] not in fields:
            fields[r["field"]] = ET.SubElement(root, "field", name=r["field"])
        e = ET.SubElement(fields[r["field"]], r["kind"])
        if r.get("activity"):
            e.set("activity", r["activity"])
        ET.SubElement(e, "script").text = r.get("script") or ""
    return ET.tostring(root, encoding="unicode")


def datasets_xml(values: list[dict]) -> str:
    """A datasets packet of values by path; groups may hold groups."""
    root = ET.Element("datasets")
    data = ET.SubElement(root, "data")
    groups: dict[tuple[str, ...], ET.Element] = {(): data}
    for v in values:
        path = tuple((v.get("path") or v["name"])[: -len(v["name"])].rstrip(".").split(".")) if (v.get("path") or v["name"]) != v["name"] else ()
        for i in range(len(path)):
            if path[: i + 1] not in groups:
                groups[path[: i + 1]] = ET.SubElement(groups[path[:i]], path[i])
        ET.SubElement(ET.SubElement(groups[path], "field", name=v["name"]), "value").text = v.get("value") or ""
    return ET.tostring(root, encoding="unicode")


def from_attributes(rows: list[dict]) -> str:
    """The packet whose ``attributes`` these are, in their order."""
    made: dict[str, ET.Element] = {}

    def element(path: str) -> ET.Element:
        if path not in made:
            up, _, name = path.rpartition("/")
            tag = name.split("[")[0]
            made[path] = ET.SubElement(element(up), tag) if up else ET.Element(tag)
        return made[path]

    for r in rows:
        e = element(r["path"])
        if r.get("attribute"):
            e.set(r["attribute"], r["value"])
        else:
            e.text = r["value"]
    return ET.tostring(next((e for p, e in made.items() if "/" not in p), ET.Element("config")), encoding="unicode")


def _pairs(m) -> list[tuple[str, str]]:
    return list(m.items()) if isinstance(m, dict) else [tuple(x) for x in (m if m is not None else ())]


def locales_xml(rows: list[dict]) -> str:
    root = ET.Element("localeSet")
    for r in rows:
        if r.get("is_default"):
            root.set("default", r["code"])
        e = ET.SubElement(root, "locale", code=r["code"], name=r.get("name") or "")
        for k, v in _pairs(r.get("settings")):
            ET.SubElement(e, k).text = v
    return ET.tostring(root, encoding="unicode")


def connections_xml(rows: list[dict]) -> str:
    root = ET.Element("connectionSet")
    for r in rows:
        e = ET.SubElement(root, "connection", name=r["name"], type=r.get("type") or "")
        ET.SubElement(e, "uri").text = r.get("uri") or ""
        for k, v in _pairs(r.get("properties")):
            ET.SubElement(e, k).text = v
    return ET.tostring(root, encoding="unicode")


def styles_xml(rows: list[dict]) -> str:
    root = ET.Element("stylesheet")
    for r in rows:
        e = ET.SubElement(root, "style", name=r["name"], type=r.get("type") or "")
        parts: dict[str, ET.Element] = {}
        for k, v in _pairs(r.get("properties")):
            tag, _, attribute = k.partition(".")
            if tag not in parts:
                parts[tag] = ET.SubElement(e, tag)
            parts[tag].set(attribute, v)
    return ET.tostring(root, encoding="unicode")
