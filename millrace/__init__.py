"""Order-book, trade and corpus analytics written as Spark DataFrame jobs."""
