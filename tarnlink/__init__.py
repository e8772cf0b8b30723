"""Record-linkage and data-preparation engine on PySpark DataFrames."""
