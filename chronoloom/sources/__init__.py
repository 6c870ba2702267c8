"""Where records come from and go to: transactions, text, HTTP, the test tables."""
