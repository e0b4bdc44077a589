"""Dataset-level operators: nearest neighbours, index building, votes, metrics, sampling."""
