"""Sources of files below guarded roots, and sinks that publish whole files."""
