"""Table schemas, readers and sinks, and the input views."""
