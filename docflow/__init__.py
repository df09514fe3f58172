"""Spark-native corpus preparation, retrieval, person-record privacy, vitals and dialogue analytics.

Every public callable is either ``Column -> Column`` (``docflow.functions``) or
``DataFrame -> DataFrame`` (``docflow.operators``, ``docflow.plans``, ``docflow.streaming``).
Nothing keeps a session global; the session is taken from the DataFrame.
"""
