"""The daily indicator feed as a stream."""
