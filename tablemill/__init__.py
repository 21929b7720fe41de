"""tablemill: cleaning, matching and summarising of untidy tables on Spark."""
