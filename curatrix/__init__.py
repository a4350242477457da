"""curatrix: a Spark-native engine for curating large described file collections."""
