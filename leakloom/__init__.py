"""leakloom: code-security findings analytics on PySpark.

Detect secrets in source trees, normalise dependency-audit reports, manage
findings over time and report on them, all as DataFrame plans.
"""
