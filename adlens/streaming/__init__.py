from adlens.streaming.daily import stream_daily, streamed_daily, streamed_sources
from adlens.streaming.exports import read_streamed, stream_exports

__all__ = ["read_streamed", "stream_daily", "stream_exports", "streamed_daily", "streamed_sources"]
