"""Streaming: nothing to build.

The analysed project reads every source once (database result sets and
collection dumps) and has no watermark, window-over-time, stateful or
continuous operator, so there is no streaming counterpart to provide.  All
operators in ``churnlens.operators`` are plain DataFrame transformations, so
they can be applied inside ``foreachBatch`` of a Structured Streaming query if
a caller wants incremental runs; no streaming-specific code is needed for that.
"""
