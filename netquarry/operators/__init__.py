"""Analytics over log tables. Functions take and return DataFrames."""
