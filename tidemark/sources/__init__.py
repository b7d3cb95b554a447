"""Files: paths through Hadoop's file systems, manifests, write-ahead logs, dumps."""
