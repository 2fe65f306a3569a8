"""Statistical procedures: DataFrame and column roles in, a small result DataFrame out."""
