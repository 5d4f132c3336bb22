"""landlens: Spark jobs for document monitoring, opinion ledgers and site maps."""
