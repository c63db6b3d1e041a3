"""operators of the event-stream engine."""
