"""Experiments' logs: parameters that changed after the holdout was opened."""

from eventide.operators import splits


def test_logs(spark):
    rows = [
        ("ok", "2026-01-01", "2026-02-01T10:00", 2, "2026-01-15", True), ("late", "2026-01-01", "2026-02-01T10:00", 1, "2026-02-01T10:01", False), ("none", "2026-01-01", "2026-02-01T10:00", 0, "2026-03-01", True),
        ("closed", "2026-01-01", None, 3, "2026-03-01", True), ("undated", None, "2026-02-01", 1, "2026-03-01", True), ("unsaid", "2026-01-01", "2026-02-01", None, None, True),
    ]
    df = spark.createDataFrame(rows, f"name string, {splits.CREATED} string, {splits.OPENED} string, {splits.CHANGES} long, {splits.LAST_CHANGE} string, want boolean")
    assert splits.logs_intact(df).where("intact <> want or intact is null").count() == 0
    assert splits.logs_intact(df.select("name", splits.OPENED)).where("intact").count() == len(rows)
