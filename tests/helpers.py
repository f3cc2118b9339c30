"""Comparisons of results."""


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows_of(df, *columns):
    columns = columns or tuple(sorted(df.columns))
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def same_as_sql(spark, duck, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows_of(df, *columns) == sorted((tuple(plain(x[i]) for i in at) for x in want.fetchall()), key=repr)
