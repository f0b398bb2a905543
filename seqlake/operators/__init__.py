"""DataFrame operators: seeds, scores, ranking, alignment, structure, suffixes, reports."""
