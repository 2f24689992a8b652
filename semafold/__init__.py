"""Semantic data federation on PySpark: say what columns mean, ask for meanings, let Catalyst plan the joins."""
