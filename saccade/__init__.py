"""saccade: event-stream analytics as Spark DataFrame plans."""
