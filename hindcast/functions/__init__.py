"""Native column functions: text, ids, clocks, returns, policy, wire format."""
