"""Teaching-corpus engine on PySpark: every operator takes and returns DataFrames."""
