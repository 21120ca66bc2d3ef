"""sievekit: turn a corpus of messy text documents into queryable tables on Spark.

Stages (each a DataFrame -> DataFrame function):

    documents -> fragments -> records -> record_fields -> schemas / groups / queries
"""

__version__ = "0.1.0"
