"""Per-document evaluation in Python workers, for what has no column form: trees, templates, construction."""
