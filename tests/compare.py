"""Rows of a DataFrame and of a DuckDB result as sorted text, columns by name, floats at six places."""

from __future__ import annotations


def _text(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(v):
        if v is None or v != v:
            return "NULL"
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return [tuple(names[i] for i in order), *sorted(tuple(one(r[i]) for i in order) for r in found)]


def spark_rows(df) -> list[tuple]:
    return _text(df.columns, df.collect())


def duck_rows(con, sql: str) -> list[tuple]:
    done = con.execute(sql)
    return _text([d[0] for d in done.description], done.fetchall())
