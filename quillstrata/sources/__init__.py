"""Reading, writing and provenance."""
