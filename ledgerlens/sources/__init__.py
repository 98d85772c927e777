"""Sources: driver tables, derived views, file readers and sinks."""
