"""functions of the plumbline engine."""
