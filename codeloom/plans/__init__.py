"""Query plans: the catalogue of named questions, built from operators."""
