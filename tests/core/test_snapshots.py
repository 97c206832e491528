"""Snapshots: catalogue, mirror and rotation, and that a damaged copy shows."""

from tessella.operators import snapshots as s


def test_catalogue_mirror_rotation(spark, tmp_path):
    root, mirror = f"file://{tmp_path}/dumps", f"file://{tmp_path}/mirror"
    assert s.days(spark, root) == [] and s.catalogue(spark, root).count() == 0 and s.rotate(spark, root) == []
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id int, day_text string")
    for day in ("2024-01-01", "2024-01-02", "2024-01-15"):
        s.take(df, day, root)
    s.take(df.limit(0), "2024-01-10", root)
    s.take(df, "2024-01-15", root)  # again: replaces itself
    found = {r["day"]: tuple(r)[1:] for r in s.catalogue(spark, root).collect()}
    assert found["2024-01-10"] == (0, "0") and found["2024-01-15"] == found["2024-01-01"] and found["2024-01-15"][0] == 4
    assert s.bring_up(spark, root, mirror) == ["2024-01-01", "2024-01-02", "2024-01-10", "2024-01-15"] and s.bring_up(spark, root, mirror) == []
    for changed in ([(1, "a"), (2, None), (3, "")], [(1, "a"), (2, ""), (2, None), (3, "")], [(1, "b"), (2, None), (2, None), (3, "")], [(1, "a"), (2, None), (3, ""), (3, "")]):
        s.take(spark.createDataFrame(changed, "id int, day_text string"), "2024-01-15", mirror)
        assert [r["day"] for r in s.compare(spark, root, mirror).where("NOT same").collect()] == ["2024-01-15"]
    assert s.bring_up(spark, root, mirror) == ["2024-01-15"]
    assert s.rotate(spark, root) == ["2024-01-01"] and s.days(spark, root) == ["2024-01-02", "2024-01-10", "2024-01-15"]
    assert s.bring_up(spark, root, mirror) == ["2024-01-01"] and s.days(spark, mirror) == s.days(spark, root)
    (tmp_path / "dumps" / "day=2024-01-15" / "_SUCCESS").unlink()  # a dump that stopped half way
    assert s.days(spark, root) == ["2024-01-02", "2024-01-10"]
