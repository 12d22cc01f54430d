"""Run registered queries next to their SQL and compare the rows exactly."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float):
        return v + 0.0
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def compare(con, df, statement) -> str | None:
    """None when the frame equals the statement's result, otherwise what differs."""
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    got = [tuple(r) for r in df.collect()]
    res = con.execute(statement)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    want_types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({statement}) LIMIT 0").description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got_types != want_types:
        diff = {k: (got_types[k], want_types[k]) for k in got_types if got_types[k] != want_types[k]}
        return f"types (spark, sql) {diff}"
    a, b = _rows(got, df.columns), _rows(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"columns {sorted(names)}: row {x} != {y}"
    return None


def main(sf_dir: str, only: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tests.session import make_session

    spark, con = make_session(), oracle(sf_dir)
    statements = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in statements:
                problem = compare(con, build(spark, sf_dir), statements[name])
            else:
                n = build(spark, sf_dir).count()
                problem = None if n else "no rows"
                print(f"   rows-only {n}", end=" ")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - t:6.2f}s {'ok' if problem is None else 'DIFF ' + problem}", flush=True)
    print("different:", bad, "of", len(entry.queries()))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
