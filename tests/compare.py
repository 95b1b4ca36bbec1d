import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    cols = sorted(names)
    return cols, sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall()), key=repr)
