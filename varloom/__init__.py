"""varloom: variant review, cohort search and corpus preparation as Spark DataFrame operators."""
