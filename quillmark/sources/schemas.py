"""JSON schema documents (draft 7) of what bundles hold, made from the types of their relations."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, StructType

DRAFT = "http://json-schema.org/draft-07/schema#"
#: Kind of document -> its title and fields; ``not null`` marks those that must be there. Fixed values.
DOCUMENTS = {
    "manifest": (
        "Manifest",
        """module string not null, jdk string, build string, entrypoints array<string>, packagesRoot string, sourceGlobs array<string>,
        files array<struct<path: string not null, package: string, class: string, kind: string, summary: string, exports: array<string>,
        dependsOn: array<string>, hash: string, lines: int, anchors: array<struct<name: string not null, start: int not null, end: int not null>>,
        tags: array<string>>> not null""",
    ),
    "symbols": ("Symbols", "version int not null, symbols array<struct<symbol: string not null, kind: string not null, path: string not null, start: int not null, end: int not null>> not null"),
}


def described(t: DataType) -> dict:
    if isinstance(t, StructType):
        must = [f.name for f in t.fields if not f.nullable]
        return {"type": "object", **({"required": must} if must else {}), "properties": {f.name: described(f.dataType) for f in t.fields}}
    if isinstance(t, ArrayType):
        return {"type": "array", "items": described(t.elementType)}
    return {"type": {"string": "string", "int": "integer", "bigint": "integer", "boolean": "boolean", "double": "number"}[t.simpleString()]}


def document(kind: str) -> dict:
    """The schema of ``manifest`` or ``symbols`` documents."""
    title, fields = DOCUMENTS[kind]
    return {"$schema": DRAFT, "title": title} | described(StructType.fromDDL(fields))


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a document departs from a schema made here, in order of its places."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}
    kind = schema["type"]
    if not isinstance(value, kinds[kind]) or (isinstance(value, bool) and kind != "boolean"):
        return [f"{at}: is no {kind}"]
    out = [f"{at}: has no {x}" for x in schema.get("required", []) if x not in value]
    if kind == "object":
        return out + [y for k, x in schema["properties"].items() if k in value for y in faults(value[k], x, f"{at}.{k}")]
    return out + [y for i, v in enumerate(value) for y in faults(v, schema["items"], f"{at}[{i}]")] if kind == "array" else out

