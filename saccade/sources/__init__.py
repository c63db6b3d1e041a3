"""sources of the event-stream engine."""
