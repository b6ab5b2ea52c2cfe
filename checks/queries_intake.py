"""Intake filters, channel settings, posts on disk, the stream."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from checks.ctes import CTES
from checks.registry import query
from georeport.functions.labels import utc_iso
from georeport.operators import filters
from georeport.operators.common import scratch_path
from georeport.plans.intake import select_posts
from georeport.plans.report import report
from georeport.sources import posts as post_files
from georeport.streaming import intake as stream

START, END = "2024-01-05", "2024-01-20"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_PHRASE = "EXISTS (SELECT 1 FROM fx_vocab v WHERE v.r IN (40, 41, 42) AND contains(lower(text), v.w))"
_BLACK = "EXISTS (SELECT 1 FROM fx_vocab v WHERE v.r IN (43, 44, 45) AND contains(lower(text), v.w))"

CTES.update({
    "fx_messages": """SELECT channel, post_id, CASE WHEN post_id % 50 <> 7 THEN micros END AS micros, CASE post_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' || text || chr(10) END AS message,
        CASE WHEN post_id % 11 <> 0 THEN text END AS raw_text FROM fx_posts""",
    "fx_channels": """SELECT source AS channel_name, CASE WHEN no % 3 <> 0 THEN upper(source) ELSE source END AS alias, CASE WHEN no % 5 <> 0 THEN CASE WHEN no % 2 = 0 THEN 'en' ELSE 'de' END ELSE 'en' END AS channel_lang,
        coalesce(CASE WHEN no % 7 <> 6 THEN no % 4 <> 0 END, false) AS active FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS no FROM documents)""",
    "fx_texted": f"SELECT *, trim(coalesce(nullif(message, ''), raw_text, ''), {_BLANK}) AS text FROM fx_messages",
    "fx_in_window": "SELECT * FROM fx_texted WHERE micros >= epoch_us(TIMESTAMP '2024-01-05') AND micros < epoch_us(TIMESTAMP '2024-01-21')",
    "fx_routed": f"""SELECT m.*, alias, channel_lang FROM fx_in_window m JOIN fx_channels c ON c.channel_name = m.channel AND c.active WHERE text <> '' AND {_PHRASE}
        AND (channel_lang = 'en' OR ((channel_lang <> 'de' OR NOT {_BLACK}) AND length(text) >= 40))""",
})
_ISO = "strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%SZ')"


def _texted(fx):
    return fx.messages.withColumn("text", filters.message_text(F.col("message"), F.col("raw_text")))


def _selected(fx, messages=None):
    channels = post_files.active_channels(fx.channels, fx.channels)
    return select_posts(fx.messages if messages is None else messages, channels, START, END, fx.phrases, fx.blacklist, "de")


@query("b01_phrase_filter", f"SELECT post_id FROM fx_texted WHERE {_PHRASE}")
def _(fx):
    return _texted(fx).filter(filters.contains_any(F.col("text"), fx.phrases)).select("post_id")


@query("b02_day_window", "SELECT post_id FROM fx_in_window")
def _(fx):
    return fx.messages.filter(filters.day_window(F.col("published_at"), START, END)).select("post_id")


@query("b03_message_text", "SELECT post_id, text FROM fx_texted WHERE text <> ''")
def _(fx):
    return _texted(fx).filter("text <> ''").select("post_id", "text")


@query("b04_blacklist", f"SELECT post_id FROM fx_texted t JOIN fx_posts p USING (post_id, channel) WHERE p.channel_lang <> 'de' OR NOT {_BLACK.replace('lower(text)', 'lower(t.text)')}")
def _(fx):
    rows = _texted(fx).join(fx.posts.select("post_id", "channel_lang"), "post_id")
    return rows.filter(filters.not_blacklisted(F.col("text"), F.col("channel_lang"), fx.blacklist, "de")).select("post_id")


@query("b05_language_routing", "SELECT post_id, channel, channel_lang, channel_lang <> 'en' AS needs_translation FROM fx_routed")
def _(fx):
    return _selected(fx).select("post_id", "channel", "channel_lang", "needs_translation")


@query("b06_post_records", f"""SELECT 'telegram' AS source, channel, alias, channel_lang, post_id, {_ISO} AS published_at, CASE WHEN channel_lang <> 'en' THEN text END AS raw_text, text FROM fx_routed""")
def _(fx):
    return post_files.post_records(_selected(fx)).select("source", "channel", "alias", "channel_lang", "post_id", "published_at", "raw_text", "text")


@query("a06_active_channels", "SELECT channel_name, alias, channel_lang, active, n AS n_posts FROM fx_channels JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = channel_name WHERE active")
def _(fx):
    path = scratch_path(fx.spark, "channels")
    fx.channels.write.json(path)
    counts = fx.table("documents").groupBy(F.col("source").alias("channel_name")).agg(F.count("*").alias("n_posts"))
    got = post_files.read_channels(fx.spark, path, fx.channels.withColumn("active", F.lit(True)))
    return got.join(counts, "channel_name").select("channel_name", "alias", "channel_lang", "active", "n_posts")


@query("a15_written_posts", f"SELECT channel, post_id, {_ISO} AS published_at, substr({_ISO}, 1, 10) AS dt, text FROM fx_routed")
def _(fx):
    path = scratch_path(fx.spark, "posts")
    post_files.write_posts(_selected(fx), path)
    got = post_files.read_posts(fx.spark, path)
    return got.select("channel", "post_id", utc_iso(F.col("published_at")).alias("published_at"), F.col("dt").cast("string").alias("dt"), "text")


@query("d12_record_counts", "SELECT count(*) AS n_written FROM fx_routed")
def _(fx):
    return _selected(fx).agg(F.count("*").alias("n_written"))


@query("h15_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso FROM events")
def _(fx):
    e = fx.table("events")
    ts = F.col("ts")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":
        ts = F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), "UTC")))
    return e.select("event_id", utc_iso(ts).alias("iso"))


@query("l01_streamed_posts", f"SELECT channel, post_id, {_ISO} AS published_at, text FROM fx_routed")
def _(fx):
    landing, out, state = (scratch_path(fx.spark, x) for x in ("landing", "streamed", "state"))
    # Newest days first, and half of the messages twice; the stream goes on after each arrival. An arrival has as many files as tasks write.
    late, doubled = F.col("published_at") < "2024-01-12", F.col("post_id") % 2 == 0
    channels = post_files.active_channels(fx.channels, fx.channels)
    for some in (~late, late, doubled):
        fx.messages.filter(some).write.mode("append").json(landing)
        posts = stream.stream_posts(stream.message_stream(fx.spark, landing), channels, START, END,
                                    phrases=fx.phrases, words=fx.blacklist, blacklist_lang="de")
        stream.write_stream(posts, out, state).awaitTermination()
    return post_files.read_posts(fx.spark, out).select("channel", "post_id", utc_iso(F.col("published_at")).alias("published_at"), "text")


def _numbered_by_channel(messages):
    """All messages, numbered from 1 in each channel in order of post_id.

    A channel may have most of the messages, so it is numbered in blocks of ids; only the blocks' counts are summed per channel.
    """
    rows = messages.withColumn("_block", F.floor(F.col("post_id") / 1000))
    counts = rows.groupBy("channel", "_block").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("channel").alias("_channel"), F.col("_block").alias("_of"),
                           (F.sum("_n").over(W.partitionBy("channel").orderBy("_block")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_no", F.row_number().over(W.partitionBy("channel", "_block").orderBy("post_id")))
    rows = rows.join(before, rows["channel"].eqNullSafe(before["_channel"]) & rows["_block"].eqNullSafe(before["_of"]))
    return rows.withColumn("post_id", F.col("_before") + F.col("_no")).select(*messages.columns)


@query("l02_report_of_messages")
def _(fx):
    """The whole way from messages to places, with ids that repeat over channels."""
    posts = _selected(fx, _numbered_by_channel(fx.messages))
    return report(posts, fx.patterns, fx.gazetteer, fx.segments, partitions=fx.spark.sparkContext.defaultParallelism).mentions
