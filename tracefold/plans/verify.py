"""Compare a Spark query with its DuckDB oracle: names, coarse types, row count, value hash."""

from __future__ import annotations

import hashlib
import math
import os

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(rows, cols):
    lines = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck_connect(sf_dir: str, tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    srows = [r.asDict() for r in spark_df.collect()]
    stypes = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: str(d[1]) for d in res.description}
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    scols = sorted(stypes)
    if scols != sorted(dcols):
        return False, f"columns differ: {scols} vs {sorted(dcols)}"
    tmis = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    if tmis:
        return False, f"types differ: {tmis}"
    hs, ls = digest(srows, scols)
    hd, ld = digest(drows, scols)
    if len(srows) != len(drows) or hs != hd:
        only_s = sorted(set(ls) - set(ld))[:3]
        only_d = sorted(set(ld) - set(ls))[:3]
        return False, f"rows {len(srows)} vs {len(drows)}; only spark {only_s}; only duck {only_d}"
    return True, f"{len(srows)} rows"
