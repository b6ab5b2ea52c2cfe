"""The query from messages to places takes every message."""

import collections
from types import SimpleNamespace

from checks import queries_intake
from checks.registry import QUERIES


def test_report_takes_every_message(spark, monkeypatch):
    rows = [("src1" if i % 3 else f"src{i % 7}", 40 * i + 5, "alpha is in this text number %d, which is long enough" % i) for i in range(120)]
    messages = spark.createDataFrame([(c, i, "2024-01-10 00:00:00", t, t) for c, i, t in rows], "channel string, post_id long, published_at string, message string, raw_text string")
    channels = spark.createDataFrame([(f"src{i}", f"S{i}", "en", True) for i in range(7)], "channel_name string, alias string, channel_lang string, active boolean")
    fx = SimpleNamespace(spark=spark, messages=messages.withColumn("published_at", messages["published_at"].cast("timestamp")), channels=channels,
                         phrases=["ALPHA"], blacklist=["beta"], patterns=None, gazetteer=None, segments=None)
    monkeypatch.setattr(queries_intake, "report", lambda posts, *_, **__: SimpleNamespace(mentions=posts))
    got = QUERIES["l02_report_of_messages"](fx).collect()
    want, n = [], collections.Counter()
    for c, _, t in sorted(rows, key=lambda x: x[1]):
        n[c] += 1
        want.append((c, n[c], t))
    assert sorted((r["channel"], r["post_id"], r["text"]) for r in got) == sorted(want)
