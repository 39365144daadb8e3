"""quillon: live relational queries, change capture and view records on Spark."""
