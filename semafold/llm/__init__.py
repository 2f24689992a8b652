"""Training-data operators: deduplication, scoring, packing, tokenising, search. Nothing outside this package imports it."""
