"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from lorewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def block_suggestions(duck):
    """Suggestions by matching blocks, one pair at a time."""
    asked = [r[0] for r in duck.execute("SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || p_brand FROM part").fetchall()]
    names = [r[0] for r in duck.execute("SELECT DISTINCT p_name FROM part").fetchall()]
    out = []
    for q in asked:
        best = [(SequenceMatcher(None, q.lower(), n.lower(), autojunk=False).ratio() + (0.2 if q.lower() in n.lower() else 0), n) for n in names]
        out += [(q, n, r) for r, n in sorted(((r, n) for r, n in best if r >= 0.45), key=lambda x: (-x[0], x[1]))[:3]]
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    if name == "fuzzy_suggest_blocks":
        assert got == table(("query", "name", "ratio"), block_suggestions(duck))
        return
    found = duck.execute(registry.SQL[name])
    assert got == table([c[0] for c in found.description], found.fetchall())


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
