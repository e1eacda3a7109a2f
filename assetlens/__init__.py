"""assetlens: Spark-native analytics over public officials' asset declarations."""
