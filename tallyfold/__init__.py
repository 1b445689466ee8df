"""Tallyfold: a PySpark-native engine for bitemporal ledgers and official statistics."""
