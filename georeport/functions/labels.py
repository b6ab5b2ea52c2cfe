"""Small text expressions for records and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from georeport.functions.keys import strip


def utc_iso(ts: Column) -> Column:
    """ISO text in UTC with ``Z``, whatever the session time zone is."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    frac = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac == "000000", "").otherwise(F.concat(F.lit("."), frac)),
                    F.lit("Z"))


def snippet(text: Column, n: int) -> Column:
    t = F.translate(strip(F.coalesce(text, F.lit(""))), "\n", " ")
    return F.concat(F.left(t, F.lit(n)), F.when(F.length(t) > n, "…").otherwise(""))


# Trigger words of each action class.
ACTION_WORDS = {
    "attack": ("attack", "attacked", "assault"),
    "advance": ("advance", "advanced"),
    "defense": ("defend", "defended"),
    "capture": ("capture", "captured", "took"),
}


def action_text(trigger: Column) -> Column:
    verb = strip(F.lower(F.coalesce(trigger, F.lit(""))))
    return F.when(verb != "", verb)


def action_kind(trigger: Column) -> Column:
    verb = action_text(trigger)
    kind = F.when(verb.isNull(), F.lit(None)).when(verb.contains("shell"), "shelling")
    for name, words in ACTION_WORDS.items():
        kind = kind.when(verb.isin(*words), name)
    return kind.otherwise("other")


def action_label(trigger: Column) -> Column:
    kind = action_kind(trigger)
    return F.when(kind == "shelling", "artillery_shelling").otherwise(kind)
