"""tidemark: a PySpark-native engine for mixed-frequency series and event feeds."""
