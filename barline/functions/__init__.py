"""Column functions: numbers, series, signals, indicators, codes and dates."""
