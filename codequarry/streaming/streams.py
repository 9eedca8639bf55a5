"""Streams: churn windows, findings of new file versions, author sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.increments import latest
from ..operators.rules import attach_suggestion, content_markers
from ..sources.sinks import append_markers
from ..storage import cut


def stream_file_churn(commits: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "2 days") -> DataFrame:
    """(window_start, path, commits): commits per path and window; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = commits.withWatermark("ts", watermark).groupBy(w.alias("w"), "path").agg(F.count("*").alias("commits"))
    return rows.select(F.col("w.start").alias("window_start"), "path", "commits")


def stream_author_sessions(commits: DataFrame, gap: str = "2 hours", watermark: str = "1 day") -> DataFrame:
    """(email, session_start, session_end, commits): activity with pauses of at most ``gap``."""
    rows = commits.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "email").agg(F.count("*").alias("commits"))
    return rows.select("email", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "commits")


def stream_markers(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Findings of new file versions take the place of those of the same files; all other findings stay.

    Of a file's versions in one batch the last one counts (by last_mod). A batch is appended as versions of its files, which
    ``load_markers`` resolves and ``compact_markers`` folds together, so what a batch writes follows its own size. A batch that runs
    again gives the same table.
    """

    def append(batch: DataFrame, _: int) -> None:
        batch = cut(latest(batch, ["repo_id", "path"], "last_mod"), "stream_files")
        append_markers(attach_suggestion(content_markers(batch)), batch.select("repo_id", F.col("path").alias("file")), path)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result table (for small results and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
