"""Parsers as table functions: frames, failures that stay with their row, messages of several lines."""

from loomwatch.operators import plugins


def test_frames():
    cut = lambda x: [m for _, m in plugins.octet_counted(x)]
    assert cut("3 abc5 de fg") == ["abc", "de fg"] and cut("") == [] and cut("3 éx") == ["éx"]
    assert cut("9 abc") == ["abc"] and cut("no length") == ["no length"] and cut("1 a-b") == ["a", "-b"] and cut("0 0 ") == ["", ""]


def test_lateral_keeps_failures_with_their_row(spark):
    def numbers(payload):
        for i, x in enumerate(payload.split()):
            yield i, int(x)

    plugins.register_parsers(spark, {"numbers": numbers}, "position int, value int")
    raw = spark.createDataFrame([(1, "4 5"), (2, "6 x 7"), (3, ""), (4, None)], "id int, payload string")
    rows = spark.sql("SELECT id, position, value, error IS NULL AS ok FROM {raw}, LATERAL numbers(payload)", raw=raw).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, 4, True), (1, 1, 5, True), (2, 0, 6, True), (2, None, None, False)], key=str)


def test_stitched(spark):
    plugins.register_stitched(spark)
    rows = [(1, "a", "head"), (2, "a", " more"), (3, "a", "\tmore"), (4, "a", None), (5, "b", " alone"), (6, "b", "x"), (7, None, "n"), (8, None, " n")]
    lines = spark.createDataFrame(rows, "id long, host string, line string")
    sql = "SELECT * FROM stitched(TABLE(SELECT * FROM {lines}) PARTITION BY host ORDER BY id)"
    got = sorted(map(tuple, spark.sql(sql, lines=lines).collect()))
    assert got == [(1, 3, "head\n more\n\tmore"), (4, 1, ""), (5, 1, " alone"), (6, 1, "x"), (7, 2, "n\n n")]
    assert spark.sql(sql, lines=lines.limit(0)).collect() == []
