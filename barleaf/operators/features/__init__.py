"""24 trailing features: registry, column builders, per-date normalisation."""
