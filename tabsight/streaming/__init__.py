"""Streaming: intentionally empty.

The reference has no stream, watermark, window-over-time or late-data
semantics: every analysis runs on one uploaded dataset. All operators in this
package take any DataFrame, so a caller who wants them per micro-batch can
apply them inside ``foreachBatch``; no streaming operator is built here.
"""
