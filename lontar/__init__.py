"""Lontar: a PySpark-native engine for analysing semi-structured business documents."""
