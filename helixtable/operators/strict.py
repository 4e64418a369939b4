"""Strict JSON: keys that stand twice in one object, at any depth, and one canonical text for each value."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings, marks, and anything else that holds no white space.
TOKEN = re.compile(r'"(?:[^"\\]|\\[^\n\r\x85\u2028\u2029])*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.ASCII)
FAULTS = "array<struct<path:string,name:string,copies:bigint>>"


def held(token: str) -> str | None:
    """What a string token holds; None for other tokens and for escapes that JSON does not know."""
    if token[0] != '"':
        return None
    if "\\" not in token:
        return token[1:-1]
    try:
        return json.loads(token).encode("utf-8", "replace").decode()  # half a surrogate pair is no text
    except ValueError:
        return None


def twice(text: str) -> list[tuple[str | None, str | None, int]]:
    """(path, name, copies) of the keys that stand more than once in one object: one walk over the tokens, which keeps the open objects and arrays."""
    out, key = [], ""
    open_: list[list] = []  # [whether an object, path, items so far, counts of keys]

    def close(o: list) -> None:
        if o[3]:
            out.extend((o[1], k, n) for k, n in o[3].items() if n > 1)

    tokens = TOKEN.finditer(text)
    token = next(tokens, None)
    while token is not None:
        x, token = token[0], next(tokens, None)
        top = open_[-1] if open_ else None
        if x in "{[":
            if top is None:
                path = "$"
            elif not top[0]:
                path = None if top[1] is None else f"{top[1]}[{top[2]}]"
            else:
                path = None if top[1] is None or key is None else f"{top[1]}.{key}"
            open_.append([x == "{", path, 0, Counter() if x == "{" else None])
        elif x in "}]":
            if open_:
                close(open_.pop())
        elif x == "," and top is not None and not top[0]:
            top[2] += 1
        elif token is not None and token[0] == ":" and top is not None and top[0]:
            key = held(x)
            top[3][key] += 1
    for o in open_:
        close(o)
    return out


def repeated_keys(text: Column) -> Column:
    """An array of path, name, copies for each text without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"path": p, "name": k, "copies": n} for p, k, n in twice(t)] for t in texts], dtype=object)

    return F.pandas_udf(run, FAULTS, F.PandasUDFType.SCALAR_ITER)(text)


def json_faults(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, name, copies of every key that an object holds more than once; a text that is no JSON has the path NULL and the name 'INVALID'.

    Texts are walked in tasks, each once and in time that grows with its length.
    """
    met = rows.where(F.col(text).isNotNull()).select(key, text, repeated_keys(F.col(text)).alias("met_"))
    # with keys that stand twice parse_json refuses a text too: those are named already
    bad = F.when(F.try_parse_json(F.col(text)).isNull(), F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("INVALID").alias("name"), F.lit(1).cast("long").alias("copies"))))
    return met.select(key, F.explode(F.when(F.size("met_") > 0, F.col("met_")).otherwise(bad)).alias("m")).select(key, "m.path", "m.name", "m.copies")


def canonical(text: Column) -> Column:
    """One text for each JSON value: no white space, keys of objects in order, numbers in their shortest form. NULL for what is no strict JSON."""
    return F.to_json(F.try_parse_json(text))
