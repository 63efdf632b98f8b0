"""JSON schemas of extraction results, as plain dictionaries on the driver: what a model is asked for, and empty results."""

from __future__ import annotations

from typing import Any

# The most characters of a text, and of the texts that may be long.
TEXT_CHARS, LONG_TEXT_CHARS = 600, 2500
LONG_TEXTS = (
    "Catatan Khusus", "Uraian Jaminan", "Keterangan", "Syarat dan Ketentuan", "Mekanisme Skema Pembayaran", "Ketentuan Pembayaran", "Informasi Bea Meterai", "Jangka Waktu", "Persentase Sanksi/Penalti",
    "Garansi", "Garansi / SLA", "Syarat Lampiran Wajib BAST", "Pernyataan Penerimaan", "Hasil Uji Terima Keseluruhan", "Spesifikasi", "Nama Dokumen",
)


def without_fields(schema: dict[str, Any], dropped: tuple[str, ...]) -> dict[str, Any]:
    """A schema without the fields that rules fill in."""
    out = {**schema, "properties": {k: v for k, v in schema.get("properties", {}).items() if k not in dropped}}
    return out | ({"required": [k for k in schema["required"] if k not in dropped]} if "required" in schema else {})


def bounded_texts(node: Any, name: str = "") -> Any:
    """A schema whose texts have a most length, so that no field can repeat itself without end; parts inherit their field's name."""
    if isinstance(node, list):
        return [bounded_texts(x, name) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: {p: bounded_texts(s, p) for p, s in v.items()} if k == "properties" and isinstance(v, dict) else bounded_texts(v, name) for k, v in node.items()}
    if out.get("type") == "string":
        out.setdefault("maxLength", LONG_TEXT_CHARS if name in LONG_TEXTS else TEXT_CHARS)
    return out


def empty_result(schema: dict[str, Any], root: dict[str, Any] | None = None) -> dict[str, Any]:
    """The required fields without content: empty texts and lists, 0 for numbers (which counts as missing), objects of their own required fields."""
    root = schema if root is None else root

    def empty(s: dict[str, Any]) -> Any:
        if "$ref" in s:
            return empty(root["$defs"][s["$ref"].rsplit("/", 1)[-1]])
        kind = s.get("type")
        if kind == "object":
            return empty_result(s, root)
        return {"string": "", "array": [], "number": 0, "integer": 0}.get(kind)

    return {k: empty(schema["properties"][k]) for k in schema.get("required", [])}


def without_zeros(result: dict[str, Any], schema: dict[str, Any]) -> dict[str, Any]:
    """A result whose required numbers that are still 0 are null: nothing was read there."""
    numbers = {k for k in schema.get("required", []) if schema["properties"][k].get("type") in ("number", "integer")}
    return {k: None if k in numbers and v == 0 else v for k, v in result.items()}


def asked_again(templates: dict[str, Any], missing: list[str]) -> dict[str, Any]:
    """The top-level templates of missing fields; an object stays whole, since its parts tell it from its neighbours."""
    tops = {m.split(".", 1)[0] for m in missing} | set(missing)
    return {k: v for k, v in templates.items() if k in tops}
