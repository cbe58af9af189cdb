"""Files, provider feeds, models and sinks."""
