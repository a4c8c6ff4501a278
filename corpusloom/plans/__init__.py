"""Plan helpers: cutting lineage, checking sizes before a broadcast."""
