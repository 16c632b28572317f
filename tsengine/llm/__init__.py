"""Training-data operators: decontamination, URL filters, deduplication,
language identification, packing, similarity joins, PII and toxicity.

Nothing outside this subpackage imports it."""
