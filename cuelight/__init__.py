"""Timed-text analytics on Spark: subtitles, speech QC, queues and timelines."""
