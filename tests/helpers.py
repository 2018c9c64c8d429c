"""Comparison with DuckDB."""


def same_rows(df, con, sql):
    """A DataFrame's and a SQL query's rows and column names are equal, in any order."""
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=repr)
