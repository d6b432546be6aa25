"""PySpark-native extraction of typed, reconciled rows from the text and word boxes of tabular documents."""
