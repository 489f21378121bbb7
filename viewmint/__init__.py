"""Evidence-access analytics on Spark: which view of the evidence to buy."""
