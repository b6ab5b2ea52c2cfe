"""Intake by stream: order, repeats and restarts."""

import datetime as dt
import re

import pytest

from georeport.operators import common
from georeport.sources.posts import read_posts
from georeport.streaming import intake


def messages(spark, rows):
    at = [(c, i, dt.datetime(2024, 1, d, 12), f"Operational information as of {i}: " + "words " * 20, None) for c, i, d in rows]
    return spark.createDataFrame(at, "channel string, post_id long, published_at timestamp, message string, raw_text string")


def test_posts_of_any_age_arrive_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    channels = spark.createDataFrame([("a", "A", "en", True), ("b", "B", "en", True)], "channel_name string, alias string, channel_lang string, active boolean")

    def run():
        posts = intake.stream_posts(intake.message_stream(spark, landing, 1), channels, "2024-01-01", "2024-01-31")
        intake.write_stream(posts, out, state).awaitTermination()

    for day in (20, 21, 2, 3):
        messages(spark, [("a", day, day), ("b", day, day), ("a", day, day)]).coalesce(1).write.mode("append").json(landing)
    run()
    want = sorted((c, d) for c in "ab" for d in (20, 21, 2, 3))
    assert sorted((r["channel"], r["post_id"]) for r in read_posts(spark, out).collect()) == want
    messages(spark, [("a", 2, 2), ("b", 21, 21), ("a", 1, 1)]).coalesce(1).write.mode("append").json(landing)
    run()
    assert sorted((r["channel"], r["post_id"]) for r in read_posts(spark, out).collect()) == sorted([*want, ("a", 1)])


def test_crash_between_writing_and_commit(spark, tmp_path, monkeypatch):
    """The batch is run again and replaces what it wrote; later batches go on from there."""
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    channels = spark.createDataFrame([("a", "A", "en", True)], "channel_name string, alias string, channel_lang string, active boolean")
    plain, runs = intake.write_batch, []

    def falls_over(rows, path, batch):
        plain(rows, path, batch)
        runs.append(batch)
        if runs.count("1") == 1 and batch == "1":
            raise RuntimeError("lost")

    monkeypatch.setattr(intake, "write_batch", falls_over)

    def run():
        posts = intake.stream_posts(intake.message_stream(spark, landing, 1), channels, "2024-01-01", "2024-01-31")
        intake.write_stream(posts, out, state).awaitTermination()

    for day in (5, 6, 7):
        messages(spark, [("a", day, day), ("a", day - 1, day - 1)]).coalesce(1).write.mode("append").json(landing)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert runs == ["0", "1", "1", "2"]
    assert sorted(r["post_id"] for r in read_posts(spark, out).collect()) == [4, 5, 6, 7]


def test_added_tables_read_only_their_days(spark, tmp_path):
    out = str(tmp_path / "out")
    channels = spark.createDataFrame([("a", "A", "en", True)], "channel_name string, alias string, channel_lang string, active boolean")

    def posts(*days):
        return intake.select_posts(messages(spark, [("a", d, d) for d in days]), channels, "2024-01-01", "2024-01-31")

    intake.add_posts(posts(1, 2, 3), out)
    intake.add_posts(posts(3, 4, 4), out)
    assert sorted(r["post_id"] for r in read_posts(spark, out).collect()) == [1, 2, 3, 4]
    plan = intake.known_posts(spark, out, ["2024-01-03"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*2024-01-03", plan)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "none"})

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_steps_of_a_job_are_deleted(spark):
    import os
    before = common.shared_dir(spark)
    with common.job_folder(spark) as folder:
        rows = common.written(spark.range(3))
        assert rows.count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder) and common.shared_dir(spark) == before
