from tidewater.sources.files import daily_prices, index_levels, read_report, stitched, write_paths, write_report, write_text_table
from tidewater.sources.stages import run_stages


def test_scans(spark, tmp_path):
    (tmp_path / "d.csv").write_text("PERMNO,Ticker,DlyCalDt,DlyPrc,DlyFacPrc\n2,A,2020-01-02,10,2\n1,A,2020-01-02,12,2\n3,B,2020-01-02,-8,4\n4,B,2020-01-03,8,0\n")
    got = {(r.ticker, str(r.dt)): r.close for r in daily_prices(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {("A", "2020-01-02"): 6.0, ("B", "2020-01-02"): -2.0, ("B", "2020-01-03"): None}
    (tmp_path / "v.csv").write_text("DATE,Close\n01/02/2020,12.5\n01/03/2020,.\n")
    assert [(str(r.dt), r.close) for r in index_levels(spark, str(tmp_path / "v.csv")).collect()] == [("2020-01-02", 12.5)]


def test_stitch_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 2.0)], "dt string, g double").selectExpr("cast(dt as date) dt", "g")
    got = stitched(rows, rows.selectExpr("dt", "g * 10 as g"), "2020-01-02").collect()
    assert sorted(r.g for r in got) == [1.0, 20.0]
    write_paths(rows.selectExpr("*", "'m' as model"), str(tmp_path / "p"), "model")
    assert spark.read.parquet(str(tmp_path / "p")).where("model = 'm'").count() == 2


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("B", 0.12345, 2), ("A", None, 1)], "name string, x double, n int")
    write_report(rows, str(tmp_path / "r"), 4)
    back = read_report(spark, str(tmp_path / "r"), "n int, x double, name string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, None, "A"), (2, 0.1234, "B")]
    write_text_table(rows.coalesce(1), str(tmp_path / "t"), {"name": 4, "x": 8, "n": 3}, 2)
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == sorted(["name        x   n", "   A        -   1", "   B     0.12   2"])


def test_stages(spark, tmp_path):
    broken = lambda s: s.range(3).selectExpr("assert_true(id < 1) as a")
    got = run_stages(spark, [("one", lambda s: s.range(5), str(tmp_path / "1")), ("two", broken, str(tmp_path / "2")), ("three", lambda s: s.range(2), str(tmp_path / "3"))]).collect()
    assert [(r.stage, r.status, r.rows) for r in got] == [("one", "done", 5), ("two", "failed", None), ("three", "done", 2)]
    assert got[1].message and all(r.seconds >= 0 for r in got)
