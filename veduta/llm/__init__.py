"""Training-data operators: sharding, dedup, filters, mixing and classifiers over text tables.

Nothing else in the library imports this subpackage."""
