"""sceneloom: scene-graph analytics over PySpark DataFrames."""
