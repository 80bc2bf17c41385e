"""Helpers of the tests in this folder."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def oracle(spark, name):
    """Hold a query to its SQL on the smallest tables."""
    from timberline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(("the of and to in stone river bright cloud seven window paper north light engine")
                             .split()) + ("" if r.random() < 0.6 else str(r.randrange(400))) for _ in range(n))
