"""plans of the offer relevance engine."""
