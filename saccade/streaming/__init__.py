"""streaming of the event-stream engine."""
