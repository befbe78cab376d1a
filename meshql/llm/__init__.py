"""Training-data operators: extraction, filtering, deduplication, tokenisation and language-model scoring of text tables.

Nothing else in the package imports this subpackage."""
