"""Windows, positions and the versioned pipeline."""
