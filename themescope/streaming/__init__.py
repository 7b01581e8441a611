"""Structured Streaming versions of ingest, assignment and drift (STR-1..5)."""

from themescope.streaming.jobs import (  # noqa: F401
    assign_stream, dedup_stream, drift_counts_corrected, drift_counts_on_time, drift_counts_stream, drift_with_late_batch,
    ingest_stream, keep_first_stream, kept_first, landed_files, late_rows, latest_updates, run_available_now, run_batches, run_updates,
    update_centres_batch, write_stream_input,
)
