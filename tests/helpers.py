"""What tests read from DataFrames."""


def rows(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()
