"""The same operators over streams: late data, deduplication with a horizon, windows, sessions and idempotent writes."""
