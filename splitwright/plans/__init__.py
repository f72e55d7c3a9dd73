"""Ready queries over the star-schema tables, each with its check in SQL."""
