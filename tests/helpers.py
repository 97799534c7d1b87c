"""Functions that several test modules share."""


def tuples(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
