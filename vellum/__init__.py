"""vellum: a Spark-first engine for clinical text, knowledge graphs and corpus preparation."""
