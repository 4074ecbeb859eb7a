"""sources of the offer relevance engine."""
