"""Streaming: intentionally empty.

The reports are views over tables; the reference has no stream, watermark,
window-over-time or state handling, so nothing here is needed.  A caller
that keeps the trace table in a streaming sink runs the batch reports over
its latest snapshot.
"""
