"""rowquarry: typed columnar tables with exact row identity, on Spark."""
