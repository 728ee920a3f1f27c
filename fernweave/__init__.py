"""fernweave: campaign metrics, KPI series, relational state and retrieval as Spark DataFrame functions."""
