"""The announcement feed as a stream."""
