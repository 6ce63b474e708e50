"""streaming of the plumbline engine."""
