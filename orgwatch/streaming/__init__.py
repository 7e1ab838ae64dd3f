"""Health of sources from a log of fetches, in batch and as a stream."""
