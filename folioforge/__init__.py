"""folioforge: collection-curation and near-duplicate analytics on PySpark."""
