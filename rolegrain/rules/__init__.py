"""Rule packs: plain data the operators turn into column expressions.

Nothing in here touches Spark.  A pack can be swapped for another one by
passing it to the operator that takes it.
"""
