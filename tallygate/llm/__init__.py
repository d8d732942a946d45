"""Training-data operators: packing, filters, scoring, joins and deduplication over text tables."""
