import duckdb
import pytest

import __spark_entry__
from rankmatch.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["exact_off", "fuzzy_fast", "fuzzy_nucleo", "query_operators", "substring_score", "prefer_prefix_nucleo", "by_keys_best", "html", "remove_where", "batch", "add_keys", "trimmed", "exact_anchors", "most_atoms", "fast_positions", "nucleo_positions", "batch_keys"]


def test_every_query_is_there_with_its_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.queries()) <= set(queries) and set(sql) <= set(queries) and len(sql) > 50


def test_the_flagship_query(spark):
    assert __spark_entry__.entry(spark).columns == ["idx", "score"]


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.select(*(f'"{c}"' for c in columns)).fetchall())
