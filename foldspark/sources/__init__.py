"""Table adapters, change feeds and idempotent sinks."""
