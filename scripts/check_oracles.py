"""Compare every registered Spark query with its DuckDB oracle.

Usage: python scripts/check_oracles.py [SF_DIR] [name-substring ...]

Checks column names, coarse types, row count and an order-insensitive hash
of the values (doubles rounded to 6 digits). Prints one line per query and a
summary; exit code 1 if any query mismatches.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracefold.plans.catalog import all_queries  # noqa: E402
from tracefold.session import local_session  # noqa: E402
from tracefold.sources.testdata import TABLES  # noqa: E402

from tracefold.plans.verify import SPARK_TYPES, digest, duck_connect  # noqa: E402


def duck(sf_dir):
    return duck_connect(sf_dir, TABLES)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session(8)
    con = duck(sf_dir)
    bad = []
    for name, q in sorted(all_queries().items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf_dir)
            srows = [r.asDict() for r in sdf.collect()]
            stypes = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema}
        except Exception as e:  # noqa: BLE001
            print(f"ERROR  {name}: spark failed: {str(e)[:400]}")
            bad.append(name)
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"ROWS   {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            dtypes = {d[0]: str(d[1]) for d in res.description}
            drows = [dict(zip(dcols, r)) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR  {name}: duckdb failed: {str(e)[:400]}")
            bad.append(name)
            continue
        scols = sorted(stypes)
        if scols != sorted(dcols):
            print(f"SCHEMA {name}: spark {scols} vs duck {sorted(dcols)}")
            bad.append(name)
            continue
        tmis = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, scols)
        ok = hs == hd and len(srows) == len(drows)
        tag = "OK    " if ok and not tmis else ("TYPES " if ok else "DIFF  ")
        print(f"{tag} {name}: spark {len(srows)} rows, duck {len(drows)} rows {ts:.1f}s {tmis if tmis else ''}")
        if not ok:
            bad.append(name)
            sd = set(ls) - set(ld)
            dd = set(ld) - set(ls)
            print("   cols:", scols)
            print("   only spark:", sorted(sd)[:3])
            print("   only duck :", sorted(dd)[:3])
        elif tmis:
            bad.append(name)
    print(f"SUMMARY {len(bad)} bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
