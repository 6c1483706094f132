"""Sources and sinks: report files, split files, digests, manifests, reading packets."""
