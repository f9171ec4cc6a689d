"""Scalar functions of the engine as column expressions (JVM side), and the few that need Python as Arrow UDFs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the cost model.
PER_SYMBOL, PER_FILE, BASE, RESERVE, HUB, POOL, RERANK, TOP_SEEDS, CONE_TOP, CONE_FRONTIER, STATIC_CAP = 6, 13, 100, 0.05, 500, 150, 20, 6, 30, 200, 4096
FRAME = r'(?m)^\s*File "([^"]+)", line (\d+), in (\S+)'


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """Distinct lower-cased words ([A-Za-z0-9_]+) of a text; null for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9_]+)"), F.lit(1)))


def overlap(task: str | Column, name: str | Column) -> Column:
    """Number of distinct words that two texts share."""
    return F.size(F.array_intersect(words(task), words(name)))


def leaf(fqn: str | Column) -> Column:
    return F.substring_index(col(fqn), ".", -1)


def last_two(fqn: str | Column) -> Column:
    return F.substring_index(col(fqn), ".", -2)


def owner(fqn: str | Column) -> Column:
    """The name without its last part; a name of one part is its own owner."""
    return F.regexp_replace(col(fqn), r"\.[^.]*$", "")


def idf(n: int | Column, out_degree: str | Column) -> Column:
    """ln(N / (1 + degree)); negative for degrees above N - 1."""
    return F.ln((F.lit(n) if isinstance(n, int) else n) / (F.lit(1.0) + F.coalesce(col(out_degree), F.lit(0))))


def relevance(weight: Column, links: Column) -> Column:
    return weight * (F.lit(1.0) + F.ln(F.greatest(links, F.lit(1)).cast("double")))


def framing(emitted: Column, files: Column) -> Column:
    return emitted * PER_SYMBOL + files * PER_FILE + BASE


def identity(fqn: str | Column, file: str | Column, line: str | Column) -> Column:
    return F.concat(col(fqn), F.lit(" — "), col(file), F.lit(":"), col(line).cast("string"))


def provenance_line(fqn: str | Column, resolver: str = "ast+scip") -> Column:
    return F.concat(col(fqn), F.lit(f" [extracted: {resolver}]"))


def body_hash(text: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text).cast("binary"), 256))


def utf8_bytes(c: str | Column) -> Column:
    return F.octet_length(col(c))


def clean_path(c: str | Column) -> Column:
    """Forward slashes, and no dots or slashes in front (a set of characters, so '.github' loses its dot)."""
    return F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), r"^[./]+", "")


def same_path(a: Column, b: Column) -> Column:
    """Two cleaned paths are equal or one ends with the other at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def module_name(path: str | Column) -> Column:
    """Dotted module of a source path: no suffix, no leading src or lib, no trailing __init__."""
    p = F.regexp_replace(F.regexp_replace(col(path), r"\.[^./]*$", ""), r"^(src|lib)/", "")
    return F.replace(F.regexp_replace(p, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def round_trips(hop1: Column, hop2: Column, batch: int = 500) -> Column:
    """Requests that a store with batched reads by edge type would have needed for two hops."""
    return (F.ceil(hop1 / batch) + F.ceil(hop2 / batch)) * 6


def evidence_state(revision: Column, now: Column, endpoints_intact: Column) -> Column:
    """current, historical_endpoints_intact or stale; their confidences are 1.0, 0.6 and 0."""
    return F.when(revision == now, "current").when(endpoints_intact, "historical_endpoints_intact").otherwise("stale")


def frames(text: str | Column) -> Column:
    """Traceback frames (file, line, name) of a text, innermost first."""
    part = lambda i: F.regexp_extract_all(col(text), F.lit(FRAME), F.lit(i))
    return F.reverse(F.arrays_zip(part(1).alias("file"), part(2).alias("line"), part(3).alias("name")))


def _blake(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") >> 1


@F.pandas_udf(LongType())
def name_id(fqn: pd.Series) -> pd.Series:
    """63-bit id of a name: the first 8 bytes of its blake2b digest, without the lowest bit."""
    return fqn.map(_blake, na_action="ignore").astype("Int64")


@F.pandas_udf(LongType())
def edge_id(key: pd.Series) -> pd.Series:
    """63-bit id of an edge key ``type|src|dst``."""
    return key.map(_blake, na_action="ignore").astype("Int64")
