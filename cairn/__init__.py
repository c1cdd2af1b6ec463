"""A Spark engine for versioned, content-addressed snapshot catalogues."""
