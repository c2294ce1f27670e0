"""corpusloom: annotated-text analytics and training-data operators on PySpark."""
