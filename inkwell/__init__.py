"""A set-oriented analytics engine for document-to-cash data on PySpark."""
