"""Web and search analytics as Spark jobs: tables in, tables out."""
