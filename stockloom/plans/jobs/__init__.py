"""State-changing work as bulk jobs: requests and tables in; new rows, changed rows and rejects out."""
