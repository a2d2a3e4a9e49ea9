"""Ridgeline: outdoor-navigation data operators as Spark DataFrame plans."""
