"""Jobs: cleaning, audits, digests, and the exchange with an external model step."""
