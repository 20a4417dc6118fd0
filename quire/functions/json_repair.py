"""JSON from models: fences, repair of a truncated end, and what whole objects can be saved. Arrow UDFs: scans of characters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def fenceless(raw: Column) -> Column:
    """tx_fences: what stands in the first code fence, or all."""
    t = F.btrim(raw, F.lit(" \t\r\n"))
    inner = F.get(F.split(t, "```", -1), F.lit(1))
    return F.when(t.startswith("```"), F.btrim(F.regexp_replace(inner, "^json", ""), F.lit(" \t\r\n"))).otherwise(t)


def repair(raw: str) -> str:
    """Closes an open string, drops a comma at the end, closes brackets from the inside."""
    closing, quoted, skip = [], False, False
    for ch in raw:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            closing.append("}" if ch == "{" else "]")
        elif ch in "}]" and closing:
            closing.pop()
    out = raw.rstrip() + '"' * quoted
    return out.rstrip().rstrip(",") + "".join(reversed(closing))


def salvage(raw: str) -> list[str]:
    """All whole objects that parse after the first bracket of a list, at its level."""
    decoder, at, out = json.JSONDecoder(), raw.find("[") + 1, []
    while (at := raw.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(raw, at)
            out.append(raw[at:end])
            at = end
        except ValueError:
            end = balanced(raw, at)
            if end < 0:
                break
            at = end
    return out


def balanced(raw: str, at: int) -> int:
    depth, quoted, skip = 0, False, False
    for i in range(at, len(raw)):
        ch = raw[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return i + 1
    return -1


@F.pandas_udf(StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    """tx_json_repair."""
    return raw.map(lambda r: None if r is None else repair(r))


@F.pandas_udf(ArrayType(StringType()))
def salvage_json(raw: pd.Series) -> pd.Series:
    """tx_json_salvage."""
    return raw.map(lambda r: [] if r is None else salvage(r))


def parsed(raw: Column, schema: str, field: str) -> Column:
    """The ladder: as it is, repaired, or the objects that can be saved; ``field`` is a list of the objects."""
    kind = f"struct<{field}:array<{schema}>>"
    plain, fixed = F.from_json(fenceless(raw), kind)[field], F.from_json(repair_json(fenceless(raw)), kind)[field]
    saved = F.transform(salvage_json(fenceless(raw)), lambda o: F.from_json(o, schema))
    return F.coalesce(plain, fixed, saved)
