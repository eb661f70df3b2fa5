"""leafmill: book-text analytics and corpus preparation on Spark DataFrames."""
