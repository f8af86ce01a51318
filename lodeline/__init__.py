"""lodeline: analytics over file, page, log and change collections on Spark."""
