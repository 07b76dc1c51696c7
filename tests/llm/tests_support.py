"""Comparison of a DataFrame with DuckDB SQL over the same rows."""

import duckdb


def agrees(tables, df, sql):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toPandas().convert_dtypes(dtype_backend="pyarrow"))
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    key = lambda rows: sorted(repr(tuple(map(plain, r))) for r in rows)
    assert key(df.select(*columns).collect()) == key(rel.fetchall())
