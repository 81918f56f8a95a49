import datetime
import decimal


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def assert_same(df, duck, sql):
    names = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == names
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[found.columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert mine == theirs
