"""gridloom: Spark-native analytics over keyed spatial collections and ordered event streams."""
