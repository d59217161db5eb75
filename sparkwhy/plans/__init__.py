"""What to compute: queries, questions, join graphs. No Spark job starts here."""
