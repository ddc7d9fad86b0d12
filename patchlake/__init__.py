"""Pull-request analytics as Spark jobs: DataFrame in, DataFrame out."""
