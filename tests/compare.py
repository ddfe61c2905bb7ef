"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description."""
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return (f"rows {len(got)} != {len(want)}; only here {[g for g in got if g not in set(want)][:2]}"
                f" only there {[w for w in want if w not in set(got)][:2]}")
    for a, b in zip(got, want):
        if a != b:
            bad = sum(x != y for x, y in zip(got, want))
            return f"{bad}/{len(got)} rows differ: {str(a)[:300]} != {str(b)[:300]}"
    types = {type(x).__name__ for r in want[:50] for x in r}
    return f"decimal column in the SQL" if "tuple" in types else None


def main(folder: str, prefixes: list[str]) -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from newsloom.session import build_session

    spark = build_session("compare", "local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in sql:
                df = run(spark, folder)
                problem = difference(df, con, sql[name])
                n = "-"
            else:
                n, problem = len(run(spark, folder).collect()), None
        except Exception as e:  # noqa: BLE001 - report and go on
            n, problem = "-", f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:34}{time.time() - start:7.2f}s {'' if name in sql else f'rows={n}'}"
              f" {problem or ''}", flush=True)
        bad += [name] if problem else []
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
