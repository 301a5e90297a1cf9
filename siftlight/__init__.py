"""siftlight: ranked text retrieval and collection statistics as lazy Spark plans."""
