"""Sources and sinks: text matrices, lookup databases, block folders and instrument settings."""
