"""ledgerloom: payment-ledger analytics expressed as lazy Spark DataFrames."""
