"""The registered queries: name -> callable, and the SQL that gives the same rows."""
