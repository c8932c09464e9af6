"""veldtext: Spark-native text risk scanning and corpus preparation."""
