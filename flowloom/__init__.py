"""Network-traffic analytics on PySpark: packets, windows, flows, detectors, alerts, incidents, campaigns, models."""
