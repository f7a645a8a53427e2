"""Text classification analytics on PySpark: features, Naive Bayes, evaluation and class analysis."""
