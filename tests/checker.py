"""Runs registered queries against their SQL twins: python tests/checker.py [sf_dir] [name part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(dtype, series) -> str:
    if pd.api.types.is_bool_dtype(dtype):
        return "bool"
    if pd.api.types.is_integer_dtype(dtype):
        return str(dtype).lower()
    if pd.api.types.is_float_dtype(dtype):
        return "float"
    return "object"


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(cell(v) for v in r))
    return sorted(rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty string when equal, otherwise the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [(c, kind(got[c].dtype, got[c]), kind(want[c].dtype, want[c])) for c in sorted(got.columns)]
    # A nullable integer column with nulls is a float column on one side and a masked integer one on the other.
    bad = [k for k in kinds if k[1] != k[2] and not (got[k[0]].isna().any() and {k[1], k[2]} == {"float", "int64"})]
    a, b = canon(got), canon(want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2]
        miss = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only spark {str(extra)[:500]}; only sql {str(miss)[:500]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, first {str(diff[0])[:900]}"
    return f"types {bad}" if bad and len(a) else ""


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    from clausemill.session import local_session

    import __spark_entry__ as entry

    spark = local_session(8)
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: spark {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(sqls[name]).df()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql {str(e)[:700]}", flush=True)
            continue
        t2 = time.time()
        msg = compare(got, want)
        bad += bool(msg)
        flag = "FAIL" if msg else ("EMPTY" if not len(got) else "ok")
        print(f"{flag} {name} n={len(got)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {msg}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
