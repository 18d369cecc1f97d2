"""A Spark-native engine that indexes photographed items by their codes and answers lookups."""
