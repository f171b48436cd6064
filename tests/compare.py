"""Runs demo queries and their SQL side by side."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def difference(spark_df, con, sql: str) -> str | None:
    """None if rows, names and types agree, else a short description."""
    want = con.cursor().sql(sql).to_arrow_table()
    got = spark_df.toArrow()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} <> {sorted(want.column_names)}"
    names = sorted(got.column_names)
    types = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1] != t[2] and not (t[1] in ("string", "large_string") and t[2] in ("string", "large_string"))]
    rows = lambda t: sorted((repr(r) for r in zip(*[[_plain(v) for v in t.column(n).to_pylist()] for n in names])))
    a, b = rows(got), rows(want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} <> {len(b)}\n  names {names}\n  spark {only_a}\n  sql   {only_b}"
    return f"types {odd}" if odd else None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from seqmine.session import builder
    d = argv[0]
    names = argv[1:]
    spark = (builder().master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = database(d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                out = difference(queries[name](spark, d), con, oracles[name])
            else:
                out = f"no sql, {queries[name](spark, d).count()} rows"
        except Exception as exc:
            out = f"ERROR {type(exc).__name__}: {str(exc)[:4500]}"
        n = con.cursor().execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0] if name in oracles and not out else ""
        bad += bool(out) and not out.startswith("no sql")
        print(f"{name:32s} {time.time() - start:6.1f}s {n} {'ok' if out is None else out}", flush=True)
    print("failures", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
