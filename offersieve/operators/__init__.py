"""operators of the offer relevance engine."""
