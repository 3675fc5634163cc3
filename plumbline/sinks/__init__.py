"""Reports and machine-readable sinks, one row or line per finding."""
