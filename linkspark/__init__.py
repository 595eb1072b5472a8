"""linkspark: entity resolution and its analytics as DataFrame plans."""
