"""Plans: classifying requests, converting and explaining plans, validating and running them, pipeline graphs."""
