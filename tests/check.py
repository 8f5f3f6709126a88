"""Compare a query's Spark result with its SQL twin in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r)
    )


def kind(t):
    t = str(t).lower()
    if t in ("bigint", "integer", "int", "smallint", "tinyint"):
        return "integer"
    if t in ("varchar", "string"):
        return "text"
    return t


def compare(df, con, sql):
    """Empty string when equal, else a short account of the difference."""
    rel = con.sql(sql)
    want_types = {n: kind(t) for n, t in zip(rel.columns, rel.types)}
    got_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if want_types != got_types:
        return f"schema: spark {got_types} sql {want_types}"
    exact = {n: str(t).lower() for n, t in zip(rel.columns, rel.types)}
    spark_exact = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    widths = {n: (spark_exact[n], exact[n]) for n in exact
              if {"int": "integer"}.get(spark_exact[n], spark_exact[n]) != {"varchar": "string"}.get(exact[n], exact[n])}
    names, want = rows_of(rel.columns, rel.fetchall())
    _, got = rows_of(df.columns, df.collect())
    if len(want) != len(got):
        return f"rows: spark {len(got)} sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ in {names}; spark {bad[0][0]} sql {bad[0][1]}"
    return f"width: {widths}" if widths else ""
