"""Training-data pipeline operators.  Nothing else in the library imports
this subpackage; ``registry`` lists its queries for ``__spark_entry__``."""
