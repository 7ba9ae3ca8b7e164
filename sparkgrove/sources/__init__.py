"""Sources and sinks of feature tables."""
