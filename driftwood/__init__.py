"""driftwood: change-classification analytics and text-corpus operators on PySpark."""
