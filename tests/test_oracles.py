"""Every query of the library with SQL gives the rows that DuckDB gives."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from docloom.plans.registry import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(AT).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert mine
        return
    rel = duck.sql(ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted(([plain(dict(zip(names, row, strict=True))[c]) for c in columns] for row in rel.fetchall()), key=repr)
    assert mine == want
