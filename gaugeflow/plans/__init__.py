"""Ready-made questions over the stored tables, with their argument rules."""
