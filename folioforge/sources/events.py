"""A run's messages as rows, and their text log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_line(time: Column, level: Column, name: Column, message: Column) -> Column:
    """One line: time to the second, level in brackets, name, message; line breaks become spaces."""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"[\r\n]+", " ")
    return F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper(level), F.lit("] "), name, F.lit(": "), text)


def write_log(events: DataFrame, path: str) -> None:
    """Append events (time, level, name, message) to a folder of text files, in order of time within each."""
    lines = events.sortWithinPartitions("time").select(log_line(F.col("time"), F.col("level"), F.col("name"), F.col("message")).alias("value"))
    lines.write.mode("append").text(path)


def action_events(actions: DataFrame, time: Column) -> DataFrame:
    """A message for each planned action: warnings for what is removed."""
    level = F.when(F.col("kind") == "trash", "warning").otherwise("info")
    message = F.concat_ws(" ", F.col("decision"), F.col("kind"), F.col("src"), F.when(F.col("dst").isNotNull(), F.concat(F.lit("-> "), F.col("dst"))))
    return actions.select(time.alias("time"), level.alias("level"), F.concat(F.lit("folioforge."), F.col("phase")).alias("name"), message.alias("message"))
