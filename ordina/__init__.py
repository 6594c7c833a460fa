"""ordina: a PySpark-native engine for repeated-measurement panels and ordered multi-part documents."""
