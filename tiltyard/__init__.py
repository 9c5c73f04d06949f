"""tiltyard: a PySpark-native analytics engine for document-centric catalogues."""
