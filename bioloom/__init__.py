"""bioloom: Spark jobs for curating, comparing and scoring large sequence collections."""
