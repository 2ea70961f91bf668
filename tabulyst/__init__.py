"""tabulyst — tabular analytics and AutoML operators on Spark DataFrames.

Every operator takes and returns DataFrames; results are small tidy tables
(``tabulyst.result.Tables``) whose plans Catalyst optimises and executors run.
"""

__version__ = "0.1.0"
