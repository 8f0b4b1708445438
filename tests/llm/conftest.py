import pytest
from pyspark.sql import functions as F

CLASHING = (
    "id n class a b u v token rare late t1 t2 t3 score text_ _text k1 k2 task number hits items n_words language accepted "
    "probability base spans assign license path cosine _own _dir entity_counts found _found row kind norm query vector rank"
).split()


@pytest.fixture
def clash():
    """Add columns whose names operators might use themselves."""

    def add(df):
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})

    return add


@pytest.fixture
def kept():
    """The extra columns came through unchanged."""

    def check(before, after):
        names = [c for c in before.columns if c in CLASHING and before.schema[c].dataType.typeName() == "string" and c != "language"]
        assert set(before.columns) <= set(after.columns)
        assert all(r[c] == f"own {c}" for r in after.select(*names).collect() for c in names)

    return check
