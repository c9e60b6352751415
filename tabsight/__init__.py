"""tabsight: Spark-native tabular profiling, statistics, chart data and
classical supervised learning.

Every public function takes Spark DataFrames and returns Spark DataFrames;
the work runs as Spark jobs (DataFrame/SQL, MLlib, grouped pandas functions
only where no built-in exists).
"""

__version__ = "0.1.0"
