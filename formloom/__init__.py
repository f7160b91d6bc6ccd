"""Form-corpus engine on PySpark: blanks, labels, matching, plans, overlays and privacy as DataFrame work."""
