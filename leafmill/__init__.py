"""leafmill: Spark-native operators for page-image, text-region and corpus workloads."""
