"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

from plenum.functions.vocab import DEFAULT_CATEGORIES
from plenum.operators import polygons as pg
from plenum.plans import more  # noqa: F401  registers its queries
from plenum.plans import queries as q

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    cursor = duck.execute(q.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[columns.index(c)] for c in order) for r in want), key=repr)


@pytest.fixture(scope="module")
def crowded(spark, sf, tmp_path_factory):
    """Lines of five copies with shifted keys, dealt to 200 rooms of 150 pieces: chains of many seats."""
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT l_orderkey % 200 AS l_orderkey, l_partkey + k * 200 AS l_partkey, l_suppkey + k * 10 AS l_suppkey, * EXCLUDE (l_orderkey, l_partkey, l_suppkey) FROM range(5) AS r(k), '{sf}/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["g1_components", "g4_seating_zones", "f5_participates_in", "f6_entry_path", "i9_light_window_proximity"])
def test_zones_of_crowded_rooms(spark, crowded, name):
    folder, con = crowded
    df = q.QUERIES[name](spark, folder)
    cursor = con.execute(q.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(cursor.fetchall())


def test_half_digits_of_centres(spark, tmp_path):
    """Means of eight places often end on half of the sixth digit: 200 rooms with eight sofas each."""
    con = duckdb.connect()
    sofa = DEFAULT_CATEGORIES.index("sofa")
    con.execute(f"COPY (SELECT i // 8 AS l_orderkey, ({sofa} + 24 * 59)::BIGINT AS l_partkey, (hash(i) % 15)::BIGINT AS l_suppkey, (i % 8)::INT AS l_linenumber, 5.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, TIMESTAMP '2000-01-01' AS l_shipdate FROM range(1600) AS r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    cursor = con.execute(q.ORACLE_SQL["g4_seating_zones"])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    assert len(want) == 200 and {row[columns.index("size")] for row in want} == {8}
    assert sorted(tuple(r) for r in q.QUERIES["g4_seating_zones"](spark, str(tmp_path)).select(*columns).collect()) == want


def test_path_blocking_by_room(spark, sf, monkeypatch):
    """Pairs and third pieces are laid out in a room's row, not joined; the parts that they are laid out in change nothing."""
    rows = pg.path_blocking(q.Scene(spark, sf).furniture)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(tuple(r) for r in rows.collect())
    monkeypatch.setattr(pg, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(pg, "TRIPLES_AT_ONCE", 5)
    parts = sorted(tuple(r) for r in pg.path_blocking(q.Scene(spark, sf).furniture.where("room < 300")).collect())
    assert parts and [r[:3] for r in parts] == [r[:3] for r in whole if r[0] < 300]
    assert [r[3] for r in parts] == pytest.approx([r[3] for r in whole if r[0] < 300], abs=1e-12)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_every_rule_is_checked(spark, sf, monkeypatch):
    """What SQL holds against the checks, the checks hold: no rule is left out, and the room is a node that they may be about."""
    asked = []
    monkeypatch.setattr(q, "rule_tables", lambda *_: None)
    monkeypatch.setattr(q.ru, "evaluate", lambda t, rules=None: asked.extend(rules or q.ru.RULES))
    q.checks(spark, sf)
    assert len(asked) == len(q.ru.RULES) == len(q.RULE_SQL)
    rooms = q.room_ids(spark, sf).count()
    assert q._head_types(q.Scene(spark, sf)).where("id = 'room_0' AND node_type = 'room'").count() == rooms
