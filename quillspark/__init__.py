"""Analytics operators declared on the DataFrame API."""
