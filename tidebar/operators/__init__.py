"""DataFrame operators on bars, trades and portfolios."""
