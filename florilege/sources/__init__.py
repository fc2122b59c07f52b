"""Readers and writers: partitioned scans, tolerant readers, merges, checksums, exports."""
