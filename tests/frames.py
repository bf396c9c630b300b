"""Small results as Python values."""


def column(df, expr):
    """Values of one expression over a small fixture, in input order."""
    return [r[0] for r in df.select(expr).collect()]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
