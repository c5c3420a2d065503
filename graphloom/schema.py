"""Relations of the graph and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


NODES = _struct(
    ("id", _S, False), ("kind", _S, False), ("qualified_name", _S, False), ("file_path", _S, False), ("language", _S, True), ("start_line", _I, True),
    ("end_line", _I, True), ("signature", _S, True), ("docstring", _S, True), ("is_exported", _B, True),
)
EDGES = _struct(
    ("source", _S, False), ("target", _S, False), ("kind", _S, False), ("line", _I, True), ("col", _I, True), ("provenance", _S, True), ("confidence", _D, True),
    ("resolver", _S, True), ("read_write", _S, True), ("metadata", T.MapType(_S, _S), True),
)
FILES = _struct(("path", _S, False), ("hash", _S, True), ("mtime_ms", _D, True), ("node_ids", T.ArrayType(_S), True), ("role", _S, True), ("analyzer_version", _I, True))
IMPORTS = _struct(("file", _S, False), ("local_name", _S, True), ("imported_name", _S, True), ("module_spec", _S, True), ("line", _I, True), ("seq", _I, True))

ANALYZER_VERSION = 1
TRUST: dict[str, float] = {"unresolved": 0.0, "latent": 0.3, "lexical": 0.3, "heuristic": 0.5, "ast_inferred": 0.8, "ast_exact": 1.0}
#: Strength order of the provenances.
STRENGTH: dict[str, int] = {p: i for i, p in enumerate(("unresolved", "latent", "lexical", "heuristic", "ast_inferred", "ast_exact"))}
KIND_WEIGHT: dict[str, float] = {
    **dict.fromkeys(("class", "function", "method"), 1.0), **dict.fromkeys(("interface", "struct"), 0.95), **dict.fromkeys(("enum", "type_alias"), 0.8), "module": 0.7,
    **dict.fromkeys(("field", "property"), 0.55), "constant": 0.5, **dict.fromkeys(("enum_member", "export"), 0.4), "variable": 0.3, "unresolved": 0.25, "import": 0.1, "file": 0.0,
}
ROLE_WEIGHT: dict[str, float] = {"vendored": 0.2, "generated": 0.3, "test": 0.5, "doc": 0.7, "config": 0.7, "library": 1.0, "entrypoint": 1.1}
DEFINITIONS = ("class", "enum", "function", "interface", "method", "module", "struct", "type_alias")


def lookup(values: dict, key: Column, default=None) -> Column:
    """A small fixed dimension as a map literal; stays inside code generation, needs no join."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def trust(provenance: Column) -> Column:
    return lookup(TRUST, provenance)


def strength(provenance: Column) -> Column:
    return lookup(STRENGTH, provenance)
