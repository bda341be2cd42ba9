"""Index building, matching, search, phrases, highlights."""
