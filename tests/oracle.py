"""Compare a query with its SQL, the way the driver does: rows and values without order, columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6) + 0.0
        return x

    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, make, sql):
    df = make(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = canonical([d[0] for d in found.description], found.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1]), (len(mine[1]), len(theirs[1]))
    assert mine[1] == theirs[1], next((a, b) for a, b in zip(mine[1], theirs[1]) if a != b)
