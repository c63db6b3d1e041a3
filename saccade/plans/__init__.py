"""plans of the event-stream engine."""
