"""operators of the plumbline engine."""
