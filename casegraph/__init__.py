"""casegraph: link analysis over case records as PySpark DataFrame jobs."""
