"""Sessions, shared storage and multi-step plans."""
