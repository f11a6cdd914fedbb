"""Training-data operators: language models, filters, fingerprints, formats and mixing on whole tables."""
