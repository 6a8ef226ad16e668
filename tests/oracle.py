"""Run a registered query and its comparison SQL side by side."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return ("nan",)
        return ("f", float(f"{float(v):.9g}"))
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"first difference\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    kinds = {str(d[0]): str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        want = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}.get(
            f.dataType.simpleString(), "?"
        )
        if want != kinds[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}"
    return None


def main():
    import os
    import sys
    import time
    import traceback

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from quire import plans
    from quire.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in plans.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in plans.ORACLES:
                diff = compare(spark, con, sf, fn, plans.ORACLES[name])
            else:
                diff = None if fn(spark, sf).collect() else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = "".join(traceback.format_exception_only(type(e), e))[:1200]
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in plans.ORACLES else '(rows only)'} {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
