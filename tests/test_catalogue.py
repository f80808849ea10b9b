import duckdb
import pytest

from loomwatch.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(frame, columns):
    one = lambda x: "" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams_equal_their_batch_twins(spark):
    stream = {tuple(r) for r in catalogue.QUERIES["stream_threshold"](spark, DATA).collect()}
    batch = {(r["source_host"], r["event_id"], r["window_count"]) for r in catalogue.QUERIES["login_failures"](spark, DATA).collect()}
    assert stream == batch and batch
    seen = catalogue.QUERIES["stream_dedup"](spark, DATA).toPandas()
    assert (seen.groupby("fingerprint")["occurrence"].max() == seen.groupby("fingerprint").size()).all()


def test_limits_by_replay(spark):
    from loomwatch.operators import windows

    rows = [("a", i, 10.0 * i) for i in range(8)] + [("b", 20, 3.0), (None, 21, 1.0)]
    df = spark.createDataFrame(rows, "k string, event_id long, s double").selectExpr("k", "event_id", "timestamp_micros(cast(s * 1e6 as bigint)) as ts")
    got = {(r["key"], r["id"]): r["allowed"] for r in windows.sliding_limit(df, "k", 2, 25).collect()}
    assert [got["a", i] for i in range(8)] == [True, True, False, True, True, False, True, True] and got["b", 20] and len(got) == 9
    got = {(r["key"], r["id"]): r["allowed"] for r in windows.token_bucket(df, "k", 0.05, 2).collect()}
    assert [got["a", i] for i in range(8)] == [True, True, True, False, True, False, True, False]
