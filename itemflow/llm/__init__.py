"""Training-data operators: one module for each, plus ``queries`` that binds them to tables."""
