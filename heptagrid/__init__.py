"""A Spark-native analytics engine for data on an aperture-7 hexagonal grid."""
