"""What test files share (conftest.py is not to be imported: the folders below have their own)."""

FOLDER = "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
