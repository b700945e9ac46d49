"""clauseweave: privacy-policy graph analytics and corpus preparation on PySpark."""
