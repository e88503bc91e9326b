"""Training-data operators: token counts, quality and language classifiers,
BPE by distinct word, fingerprints, near and exact duplicates, packing, chat
formatting and URL filters.  Nothing outside this package imports it."""
