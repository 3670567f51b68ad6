"""Spark jobs for table analytics, document retrieval and ledgers."""
