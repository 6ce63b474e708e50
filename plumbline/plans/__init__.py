"""plans of the plumbline engine."""
