"""Session analytics and training-data preparation on PySpark.

Layers: ``sources`` read logs and tables, ``functions`` hold column
expressions, ``operators`` are DataFrame -> DataFrame steps, ``plans`` compose
them into whole queries, ``streaming`` has their incremental forms.  The
subpackage ``llm`` holds the text operators; nothing else imports it.
"""
