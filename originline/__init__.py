"""Point-in-time analytics over entity event sequences, built on PySpark."""
