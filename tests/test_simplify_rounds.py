from synframe.operators import simplify as sm


def test_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    left = iter(range(119, 0, -1))
    fewer = lambda df, gap: df.filter(f"block_id <= {next(left, 1)}")
    monkeypatch.setattr(sm, "compress_paths", fewer)
    monkeypatch.setattr(sm, "remove_bulges", fewer)
    rows = [("g", "c", i, 1, 100 * i, 100 * i + 50) for i in range(1, 121)]
    df = spark.createDataFrame(rows, "genome string, chr string, block_id long, sign int, bstart long, bend long").coalesce(1)
    assert [r.block_id for r in sm.simplify(df, 0).collect()] == [1]


def test_written_neighbours_are_not_ordered_again(spark, tmp_path):
    """A round's table carries its blocks' neighbours: compression has one window left, the search for bulges none, and both find the same."""
    rows = [(g, "c", i, 1, 100 * i, 100 * i + 50) for g in "xy" for i in range(1, 9) if (g, i) not in {("x", 3), ("y", 4)}]
    df = spark.createDataFrame(rows, "genome string, chr string, block_id long, sign int, bstart long, bend long")
    sm._lined(df).write.parquet(f"{tmp_path}/lined")
    lined = spark.read.parquet(f"{tmp_path}/lined")
    windows = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("Window ")
    assert windows(sm.compress_paths(lined, 500)) == 1 and windows(sm.bulge_blocks(lined, 500)) == 0
    assert sorted(sm.compress_paths(lined, 500).collect()) == sorted(sm.compress_paths(df, 500).collect())
    assert sorted(sm.remove_bulges(lined, 500).collect()) == sorted(sm.remove_bulges(df, 500).collect())
    assert {r.block_id for r in df.collect()} - {r.block_id for r in sm.remove_bulges(lined, 500).collect()} == {3, 4}
    assert [r.block_id for r in sm.simplify(df, 500).filter("genome = 'x'").collect()] == [1]
