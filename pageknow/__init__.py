"""pageknow: tables of pages and documents to searchable, audited knowledge, on Spark."""
