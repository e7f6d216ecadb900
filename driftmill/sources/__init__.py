"""What is read and written: image files, metadata, feature tables, and sinks."""
