"""motionspark: analytics of multi-camera movement data, and of text collections, on PySpark."""
