"""sources of the plumbline engine."""
