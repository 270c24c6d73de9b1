"""Local-business search and evidence engine on PySpark DataFrames."""
