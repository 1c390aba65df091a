"""Run registered queries next to their SQL. Usage: python tests/oracle.py [sf] [name ...]"""

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8, **conf):
    from pyspark.sql import SparkSession

    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(dtype) -> str:
    k = pd.api.types.infer_dtype(dtype, skipna=True) if isinstance(dtype, pd.Series) else str(dtype)
    return k


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.astype(int)
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float) + 0.0
            if df[c].isna().any() or (df[c] == df[c].round()).all():
                pass
        elif pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if ka != kb:
            return f"{c}: kind {a[c].dtype} != {b[c].dtype}"
    if a.equals(b):
        return None
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {bad.sum()} differ, first\n got  {a.loc[i].to_dict()}\n want {b.loc[i].to_dict()}"
    return None


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    qs, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(qs)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                want = con.execute(sql[name]).df()
                msg = compare(got, want)
                state = "ok " if msg is None else "BAD"
            else:
                msg, state = None, "rows"
        except Exception as e:  # keep going, report at the end
            t1, state = time.time(), "ERR"
            msg = "\n".join((str(e).splitlines() or [repr(e)])[:6])
            if os.environ.get("TRACE"):
                traceback.print_exc()
            got = []
        bad += state in ("BAD", "ERR")
        print(f"{state} {name} rows={len(got)} spark={t1 - t0:.2f}s all={time.time() - t0:.2f}s", flush=True)
        if msg:
            print("    ", msg, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
