"""Sources and sinks of coded images."""
