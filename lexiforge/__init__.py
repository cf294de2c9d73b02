"""lexiforge: corpus-building and corpus-inspection operators on Spark DataFrames.

Every public operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``)
so that it composes with the rest of a Spark job, runs unchanged on batch tables and,
where it is stateless, on streams.  Results depend only on the data and the seed,
never on how the data happens to be partitioned.
"""

__version__ = "0.1.0"
