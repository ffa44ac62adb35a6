"""Operators: functions from DataFrame to DataFrame, lazy and free of driver loops."""
