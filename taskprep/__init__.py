"""taskprep: Spark-native task-dataset preparation, structured-query execution
and prediction scoring."""

__version__ = "0.1.0"
