"""Run registered queries against DuckDB on the same files and compare."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = "bool:" + df[c].astype(str)
        elif pd.api.types.is_integer_dtype(df[c]) and not df[c].isna().any():
            df[c] = "i:" + df[c].astype("int64").astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = "f:" + df[c].map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            df[c] = "o:" + df[c].map(lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else f"{type(v).__name__}:{v}")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return None
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    for c in a.columns:
        if not a[c].equals(b[c]):
            i = (a[c] != b[c]).idxmax()
            return f"column {c} differs in {(a[c] != b[c]).sum()} rows, first: {a[c][i]} != {b[c][i]} | {a.loc[i].to_dict()}"
    return "differs"


def main(folder: str, only: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from panelsmith.session import local_session

    spark = local_session(8)
    con = connect(folder)
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            secs = time.time() - t0
            msg = compare(got, con.execute(sql[name]).df()) if name in sql else None
            tag = "ok" if msg is None else "BAD"
            note = "" if name in sql else " (no sql)"
            if msg or secs > 4 or not len(got) or only:
                print(f"{tag:4} {name} rows={len(got)} {secs:.1f}s{note} {msg or ''}", flush=True)
            bad += msg is not None
        except Exception as exc:  # noqa: BLE001
            bad += 1
            text = str(exc).split("JVM stacktrace")[0][:700]
            print(f"ERR  {name} {type(exc).__name__}: {text}", flush=True)
            if only and "-v" in sys.argv:
                traceback.print_exc()
    print("failures:", bad, "of", len(qs))
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(1 if main(args[0], args[1:]) else 0)
