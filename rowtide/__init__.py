"""rowtide: analytics and reversal of row-change logs on Spark."""
