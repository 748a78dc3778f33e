"""Topic mining for question-and-answer archives, written as Spark DataFrame jobs."""
