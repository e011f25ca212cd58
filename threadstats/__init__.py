"""threadstats: descriptors of people in threaded discussions, as Spark jobs.

Every function takes and returns DataFrames (or Columns); nothing here keeps
state between calls except tables written to the cluster's shared folder.
"""

__version__ = "0.1.0"
