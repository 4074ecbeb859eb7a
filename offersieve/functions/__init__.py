"""functions of the offer relevance engine."""
