"""Multi-stage runs composed of the operators."""
