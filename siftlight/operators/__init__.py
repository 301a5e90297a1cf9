"""Relational operators shared by the retrieval plans and the pipeline components."""
