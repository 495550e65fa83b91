"""Vector clauses of search queries: `filter=>[KNN k @v $p AS s]` and `@v:[VECTOR_RANGE r $p]`.

Distance is 1 - cosine, 1 where a vector has no length. Rows whose vector is null, of another
length than the parameter, or holds null or non-finite parts have no distance and are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import cosine, query_vector
from .search import Schema, search

_KNN = re.compile(r"^(?P<filter>.*)=>\s*\[KNN\s+(?P<k>\d+)\s+@(?P<field>\w+)\s+\$(?P<param>\w+)(?:\s+AS\s+(?P<score>\w+))?\s*\]$", re.I | re.S)
_RANGE = re.compile(r"^@(?P<field>\w+):\[VECTOR_RANGE\s+(?P<radius>[0-9.eE+-]+)\s+\$(?P<param>\w+)\s*\]$", re.I)


def is_vector_query(query: str) -> bool:
    return "=>[KNN " in query.upper() or ":[VECTOR_RANGE " in query.upper()


def _distance(vector: Column, wanted: list[float]) -> Column:
    whole = (F.size(vector) == len(wanted)) & F.forall(vector, lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    d = F.lit(1.0) - cosine(vector, query_vector(wanted))
    return F.when(whole, F.when((d < 0) & (d > -1e-6), F.lit(0.0)).otherwise(d))


def nearest(df: DataFrame, query: str, schema: Schema, key: str, params: Mapping[str, Sequence[float]]) -> DataFrame:
    """Matching rows with their distance as the score column (default __<field>_score), nearest first, ties by key.

    The k nearest are a top-k of partial top-ks; no row is shuffled but those.
    """
    knn = _KNN.match(query.strip())
    m = knn or _RANGE.match(query.strip())
    if not m:
        raise ValueError(f"unsupported vector query: {query}")
    field = schema.field(m["field"], "VECTOR")
    if m["param"] not in params:
        raise ValueError(f"no parameter: {m['param']}")
    wanted = [float(x) for x in params[m["param"]]]
    score = (knn and m["score"]) or f"__{field.name}_score"
    base = (m["filter"].strip() or "*") if knn else "*"
    rows = df if base in ("*", "(*)") else search(df, base, schema)
    rows = rows.withColumn(score, _distance(field.col, wanted)).where(F.col(score).isNotNull())
    if not knn:
        radius = float(m["radius"])
        if radius < 0 or not math.isfinite(radius):
            raise ValueError(f"radius: {radius}")
        return rows.where(F.col(score) <= radius).orderBy(score, key)
    return rows.orderBy(score, key).limit(int(m["k"]))
