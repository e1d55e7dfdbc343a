"""Sources and sinks: delimited text, ZIP containers, images, PDF and Office files, digests of large files."""
