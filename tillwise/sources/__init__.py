"""Files in and out, and the retail tables behind the registered queries."""
