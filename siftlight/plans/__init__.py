"""Query trees: parser, checks, retrieval models and compilation to DataFrame plans."""
