"""streaming of the offer relevance engine."""
