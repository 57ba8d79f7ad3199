"""ternfield: sparse-feature, signal and corpus analytics written as Spark jobs."""
