"""A PySpark-native engine for verified statement graphs over structured legal text."""
