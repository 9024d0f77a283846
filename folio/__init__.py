"""folio: a PySpark-native engine for archives of digitized documents."""
