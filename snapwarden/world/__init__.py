"""A synthetic world with faults and their truth. The engine never imports it."""
