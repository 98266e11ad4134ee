"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from sitefold.plans.oracle import ORACLE_SQL
from sitefold.plans.site_queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    got = rows_of([tuple(r) for r in frame.collect()], frame.columns)
    done = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(frame.columns) and got == rows_of(done.fetchall(), names)
    spark.catalog.clearCache()


def test_static_states_of_equal_urls(spark, tmp_path):
    """Pages with one url and other numbers of links: the first in the table holds, as in DuckDB with one thread."""
    page = lambda *links: "<p>" + "".join(f'<a href="/{x}">{x}</a>' for x in links)
    at = "https://tionsh.example.net/"
    rows = [
        (0, at + "a", page("b")), (1, at + "a#top", page("b", "c", "d")), (2, at + "a", page("z", "y", "c", "d")), (4, at + "e#x", page("b")), (5, at + "e#x", page("z", "y")),
        (7, at + "f", page("z", "y", "c")), (8, at + "f", page("b")), (10, at + "g", page("b", "e", "c")), (11, at + "g", page("z")), (12, at + "g", page("y", "z")),
    ]
    duck = duckdb.connect(config={"threads": 1})
    duck.execute("CREATE TABLE pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    duck.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    frame = QUERIES["static_states"](spark, str(tmp_path))
    done = duck.execute(ORACLE_SQL["static_states"])
    names = [d[0] for d in done.description]
    want = rows_of(done.fetchall(), names)
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == want and sum(int(r[sorted(names).index("n_links")]) for r in want) == 10
