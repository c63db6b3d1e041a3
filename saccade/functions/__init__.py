"""functions of the event-stream engine."""
