"""Training-data operators: DataFrame in, DataFrame out.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` in
``emberframe.llm.catalog`` list what ``__spark_entry__`` registers.
"""
