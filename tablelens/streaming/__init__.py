from tablelens.streaming.incremental import (
    read_stream,
    run_available,
    stream_engagement,
    stream_group_sizes,
    stream_window_sizes,
)

__all__ = ["read_stream", "run_available", "stream_engagement", "stream_group_sizes", "stream_window_sizes"]
