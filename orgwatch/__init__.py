"""orgwatch: Spark-native operators for organizations, their news events and the text around them."""
