"""Growing, training, scoring and explaining models."""
