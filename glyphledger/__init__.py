"""Field-level document-capture quality on Spark: readings in, normalised, repaired, validated and scored fields out."""
