"""Column expressions: time of day, headway flags, bins, array statistics."""
