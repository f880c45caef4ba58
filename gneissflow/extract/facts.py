"""Fact tables from a table of file contents (path, content, size, digest)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import line_count
from ..scratch import materialize
from .script import extract

RANGE = pa.struct([("startLine", pa.int32()), ("endLine", pa.int32())])
HERITAGE = pa.struct([("extends", pa.list_(pa.string())), ("implements", pa.list_(pa.string()))])
_S, _B = pa.string(), pa.bool_()
TYPES = {
    "symbols": [("kind", _S), ("name", _S), ("qualified_name", _S), ("signature", _S), ("jsdoc", _S), ("source", _S), ("range", RANGE), ("exported", _B), ("confidence", pa.float64()), ("is_test", _B), ("heritage", HERITAGE)],
    "imports": [("kind", _S), ("imported_name", _S), ("module_specifier", _S), ("range", RANGE)],
    "calls": [("caller_qualified_name", _S), ("callee_text", _S), ("receiver", _S), ("range", RANGE)],
    "rationale": [("marker", _S), ("symbol_qualified_name", _S), ("text", _S), ("range", RANGE)],
    "routes": [("method", _S), ("route_path", _S), ("handler_name", _S), ("range", RANGE)],
}
_R = "struct<startLine:int,endLine:int>"
DDL = {
    "symbols": f"array<struct<kind:string,name:string,qualified_name:string,signature:string,jsdoc:string,source:string,range:{_R},exported:boolean,confidence:double,is_test:boolean,heritage:struct<extends:array<string>,implements:array<string>>>>",
    "imports": f"array<struct<kind:string,imported_name:string,module_specifier:string,range:{_R}>>",
    "calls": f"array<struct<caller_qualified_name:string,callee_text:string,receiver:string,range:{_R}>>",
    "rationale": f"array<struct<marker:string,symbol_qualified_name:string,text:string,range:{_R}>>",
    "routes": f"array<struct<method:string,route_path:string,handler_name:string,range:{_R}>>",
}


@dataclass
class Facts:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    rationale: DataFrame
    routes: DataFrame


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        found = [extract(p, c or "") for p, c in zip(paths, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.list_(pa.struct(t))) for k, t in TYPES.items()]], names=["path", *TYPES])


def extract_facts(contents: DataFrame) -> Facts:
    """The file table and its five child tables; ``pos`` is the order within a file."""
    files = contents.select("path", P.language("path").alias("language"), "size", line_count("content").alias("lines"), "digest")
    ddl = "path string, " + ", ".join(f"{k} {t}" for k, t in DDL.items())
    nested = materialize(contents.select("path", "content").mapInArrow(_run, ddl), "facts")
    child = {k: nested.select("path", F.posexplode(k).alias("pos", "r")).select("path", "pos", "r.*") for k in TYPES}
    return Facts(files, **child)
