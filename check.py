"""Run registered queries next to their check SQL and compare the results.

    python check.py [--sf 0.01] [--only NAME_PART ...] [--plain]
"""

from __future__ import annotations

import argparse
import time

import duckdb

from diamondlap.plans.catalog import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8", plain: bool = False):
    from pyspark.sql import SparkSession

    if plain:  # Spark's own defaults
        spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        return spark
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("diamondlap")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return None if df.columns else "no columns", len(got)
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            cols = sorted(names)
            diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return f"differs {diff[:4]} at {a[:6]}", len(got)
    return None, len(got)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", nargs="*")
    ap.add_argument("--plain", action="store_true", help="use Spark's default settings")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = session(plain=args.plain), connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if args.only and not any(o in name for o in args.only):
            continue
        t0 = time.time()
        try:
            why, rows = compare(spark, con, name, sf_dir)
        except Exception as e:  # keep going: one report per query
            why, rows = f"ERROR {str(e)[:700]}", -1
        bad += why is not None
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'FAIL' if why else 'ok  '} {name} [{kind}] rows={rows} {time.time() - t0:.1f}s {why or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
