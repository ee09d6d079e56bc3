"""quern: a Spark-native engine that grinds laboratory and text tables into audited decisions."""
