"""Column functions: text analysis, URL features, id normalisation."""
