"""Extract schemas, readers, sinks and the derivation of extracts from the order tables."""
