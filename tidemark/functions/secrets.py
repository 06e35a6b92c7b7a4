"""Secrets masked in nested values: structs, lists and maps by expressions built from the schema, variants by a walk in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SECRET_NAMES, SECRETS, contains_any, masked

MASK = "******"
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#:]*)(?::[^/?#]*)?@"
_DATABASE = ("postgres://", "postgresql://", "postgresql+")


def _url(x: Column) -> Column:
    """A URL without its password: the user stays."""
    user = F.when(F.regexp_extract(x, _URL, 2) != "", F.concat(F.regexp_extract(x, _URL, 2), F.lit(":"))).otherwise("")
    return F.when(x.rlike(_URL), F.concat(F.regexp_extract(x, _URL, 1), user, F.lit(MASK + "@"), F.regexp_replace(x, _URL, ""))).otherwise(x)


def _scheme(x: Column) -> Column:
    """An authorization header without what follows its scheme."""
    return F.when(x.rlike(r"^\s*\S+\s+\S"), F.concat(F.regexp_extract(x, r"^\s*(\S+)", 1), F.lit(" " + MASK))).when(F.trim(x) == "", x).otherwise(MASK)


def by_name(name: Column, x: Column) -> Column:
    """The mask of a text under a secret name: headers keep their scheme, database URLs their user and host, others nothing."""
    url = F.contains(name, F.lit("database_url")) | F.startswith(x, F.lit(_DATABASE[0])) | F.startswith(x, F.lit(_DATABASE[1])) | F.startswith(x, F.lit(_DATABASE[2]))
    return F.when(x.isNull(), None).when(F.contains(name, F.lit("authorization")), _scheme(x)).when(url, _url(x)).otherwise(MASK)


def _walk(x: Column, kind: T.DataType, name: Column, secret: bool | Column) -> Column:
    """x with masks; name: of the field that x lies under; secret: whether that, or one above, is a secret's."""
    if isinstance(kind, T.StringType):
        whole, part = by_name(name, x), masked(x)
        return whole if secret is True else part if secret is False else F.when(secret, whole).otherwise(part)
    if isinstance(kind, T.StructType):
        fields = [_walk(x.getField(f.name), f.dataType, F.lit(f.name.lower()), secret if secret is True else True if _is_secret(f.name) else secret).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields)) if fields else x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda item: _walk(item, kind.elementType, name, secret))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):

        def value(key: Column, item: Column) -> Column:
            own = contains_any(F.lower(key), SECRET_NAMES)
            return _walk(item, kind.valueType, F.lower(key), True if secret is True else own if secret is False else own | secret)

        return F.transform_values(x, value)
    if secret is False or isinstance(kind, T.VariantType):
        return x
    return F.lit(None).cast(kind) if secret is True else F.when(~secret, x)


def _is_secret(name: str) -> bool:
    return any(part in name.lower() for part in SECRET_NAMES)


def masked_rows(df: DataFrame) -> DataFrame:
    """df with secrets masked in all columns, however deep.

    A text under a name that has a secret's part in it is masked whole, but for an authorization's scheme
    and a database URL's user and host; other texts have keys, bearer tokens and passwords in URLs
    masked. Under a secret name other values become null, and all below is secret. Variants keep their
    shape; in them numbers and truth values under a secret name become the mask. Nulls stay.
    """
    out = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    fields = [(f"_{i}", f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    out = out.select(*[_walk(F.col(c), kind, F.lit(name.lower()), _is_secret(name)).alias(c) for c, name, kind in fields])
    for c, name, kind in fields:
        if isinstance(kind, T.VariantType):
            out = _variant(out, c, name)
    return out.toDF(*df.columns)


#: The masks of texts for Python's patterns.
_PARTS = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", by)) for p, by in SECRETS.items()]


def _text(name: str, x: str, secret: bool) -> str:
    if not secret:
        for pattern, by in _PARTS:
            x = pattern.sub(by, x)
        return x
    if "authorization" in name:
        return x if not x.strip() else f"{x.split()[0]} {MASK}" if len(x.split()) > 1 else MASK
    if "database_url" in name or x.startswith(_DATABASE):
        found = re.match(_URL, x)
        return x if not found else f"{found[1]}{found[2] + ':' if found[2] else ''}{MASK}@{x[found.end() :]}"
    return MASK


def masked_json(x: Any, name: str = "", secret: bool = False) -> Any:
    """A parsed JSON value with masks, as masked_rows has them for variants."""
    if isinstance(x, dict):
        return {k: masked_json(v, k.lower(), secret or _is_secret(k)) for k, v in x.items()}
    if isinstance(x, list):
        return [masked_json(v, name, secret) for v in x]
    if isinstance(x, str):
        return _text(name, x, secret)
    return MASK if secret and x is not None else x


def _variant(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with one column of variants masked: as JSON text through Arrow batches, numbers kept as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_json")
            out = []
            for text in batch.column(at).to_pylist():
                value = None if text is None else masked_json(json.loads(text, parse_float=_Number, parse_int=_Number), name.lower(), _is_secret(name))
                out.append(None if text is None else _dumped(value))
            yield batch.set_column(at, "_json", pa.array(out, pa.string()))

    columns = [F.col(c) for c in df.columns if c != column]
    others = df.select(*columns, F.to_json(column).alias("_json"))
    return others.mapInArrow(run, others.schema).select(*[F.parse_json("_json").alias(c) if c == column else F.col(c) for c in df.columns])


class _Number(float):
    """A number that is written as it was read."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out

    def __repr__(self) -> str:
        return self.text


def _dumped(x: Any) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumped(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dumped, x)) + "]"
    return repr(x) if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)
